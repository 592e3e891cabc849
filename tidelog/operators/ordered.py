"""Operators on the order of a log: anchors, compaction, retention, epochs, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.scan import running


LOG = ["stream", "partition"]


def time_anchors(records: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th record of a segment with the greatest time before it (0 for the first)."""
    w = W.partitionBy(*LOG, "segment_id").orderBy("offset")
    df = records.withColumn("_i", F.row_number().over(w) - 1)
    df = df.withColumn("prefix_max", F.coalesce(F.max("timestamp_ms").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return df.filter(F.col("_i") % stride == 0).select(*LOG, "segment_id", "offset", "prefix_max")


def seek_window(anchors: DataFrame, ends: DataFrame, at_ms: int) -> DataFrame:
    """[scan_from, scan_bound) of each segment in which the first record at or after a time lies.

    The last anchor whose prefix lies before the time, and the first one after
    it; if the very first anchor meets, the window is its own stride.
    """
    meets = F.col("prefix_max") >= at_ms
    key = [*LOG, "segment_id"]
    a = anchors.groupBy(*key).agg(
        F.min("offset").alias("_first"),
        F.max(F.when(~meets, F.col("offset"))).alias("_below"),
        F.sort_array(F.collect_list(F.when(meets, F.col("offset")))).alias("_above"),
    )
    a = a.withColumn("_above", F.when(F.col("_below").isNull(), F.slice("_above", 2, 1)).otherwise(F.slice("_above", 1, 1)))
    j = a.join(ends, key)
    return j.select(*key, F.coalesce("_below", "_first").alias("scan_from"), F.coalesce(F.try_element_at("_above", F.lit(1)), F.col("end")).alias("scan_bound"))


def compact(records: DataFrame, now_ms: int, tombstone_ttl: int, run: list[str] | None = None) -> DataFrame:
    """Survivors of a compaction: rows without key, and the last row of each key in its run.

    A last row without payload is a tombstone; it goes once it is older than its
    lifetime. The last offset of a key is a partial maximum and a join, so a key
    with very many rows is not sorted anywhere.
    """
    run = run or LOG
    keyed = F.col("key") != ""
    last = records.filter(keyed).groupBy(*run, "key").agg(F.max("offset").alias("_last"))
    j = records.join(last, [*run, "key"], "left")
    gone = (F.octet_length("payload") == 0) & (F.col("timestamp_ms") + tombstone_ttl < now_ms)
    return j.filter(~keyed | (F.col("offset") == F.col("_last")) & ~gone).drop("_last")


def dirty_segments(records: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Per segment: rows, rows a compaction would drop, and the share in thousandths."""
    run = run or LOG
    last = records.filter("key <> ''").groupBy(*run, "key").agg(F.max("offset").alias("_last"))
    j = records.join(last, [*run, "key"], "left")
    drop = (F.col("key") != "") & (F.col("offset") != F.col("_last"))
    out = j.groupBy(*run, "segment_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(drop).alias("dropped"))
    return out.withColumn("dirty_permille", F.expr("dropped * 1000 div total"))


def retention(segments: DataFrame, floors: DataFrame, max_bytes: int, max_records: int, max_age_ms: int, now_ms: int) -> DataFrame:
    """Segments to reap: from the oldest on, while any bound is exceeded.

    Never past the least committed offset of the groups, never the newest
    segment, and never a segment after one that stays.
    """
    newer = W.partitionBy(*LOG).orderBy(F.desc("segment_id")).rowsBetween(W.unboundedPreceding, 0)
    older = W.partitionBy(*LOG).orderBy("segment_id").rowsBetween(W.unboundedPreceding, 0)
    s = segments.join(floors, LOG, "left").withColumn("_b", F.sum("bytes").over(newer)).withColumn("_r", F.sum("records").over(newer))
    s = s.withColumn("_newest", F.max("segment_id").over(W.partitionBy(*LOG)))
    over = (F.col("_b") > max_bytes) | (F.col("_r") > max_records) | (F.col("last_ms") + max_age_ms < now_ms)
    free = (F.col("segment_id") < F.col("_newest")) & (F.col("end") <= F.coalesce("committed", F.col("end")))
    s = s.withColumn("_go", F.bool_and(over & free).over(older))
    return s.filter("_go").select(*LOG, "segment_id", "records", "bytes")


def prefix_faults(records: DataFrame) -> DataFrame:
    """First place of each segment where offset or seq leaves the dense order."""
    w = W.partitionBy(*LOG, "segment_id").orderBy("offset")
    df = records.withColumn("_want", F.col("base") + F.row_number().over(w) - 1)
    bad = df.filter((F.col("offset") != F.col("_want")) | (F.col("seq") != F.col("_want") - F.col("base")))
    return bad.groupBy(*LOG, "segment_id").agg(F.min("offset").alias("first_bad"))


def epoch_at(records: DataFrame, epochs: DataFrame) -> DataFrame:
    """As-of join: the epoch with the greatest start at or below each offset.

    An epoch history is short; it becomes ranges [start, next start) and is joined
    by range within the log.
    """
    nxt = F.lead("start_offset").over(W.partitionBy(*LOG).orderBy("start_offset"))
    e = epochs.select(*[F.col(c).alias(f"_{c}") for c in LOG], "epoch", F.col("start_offset").alias("_start"), F.coalesce(nxt, F.lit(2**63 - 1)).alias("_end"))
    on = [F.col(c) == F.col(f"_{c}") for c in LOG] + [F.col("offset") >= F.col("_start"), F.col("offset") < F.col("_end")]
    return records.select(*LOG, "offset").join(e, on, "left").select(*LOG, "offset", "epoch")


def epoch_regressions(epochs: DataFrame) -> DataFrame:
    """Entries whose epoch is below the one before, in offset order."""
    before = F.lag("epoch").over(W.partitionBy(*LOG).orderBy("start_offset"))
    return epochs.withColumn("previous", before).filter(F.col("previous") > F.col("epoch"))


def divergence_points(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """Newest shared epoch of two histories and the offset to truncate the follower to.

    Both frames: log columns, epoch, start_offset, log_end.
    """

    def ends(df: DataFrame, name: str) -> DataFrame:
        nxt = F.lead("start_offset").over(W.partitionBy(*LOG).orderBy("epoch"))
        return df.select(*LOG, "epoch", F.coalesce(nxt, F.col("log_end")).alias(name))

    shared = ends(follower, "_f").join(ends(leader, "_l"), [*LOG, "epoch"])
    best = shared.groupBy(*LOG).agg(F.max("epoch").alias("diverged_at_epoch"), F.max_by(F.least("_f", "_l"), "epoch").alias("truncate_to"))
    start = follower.groupBy(*LOG).agg(F.min("start_offset").alias("_start"))
    j = start.join(best, LOG, "left")
    return j.select(*LOG, F.coalesce("truncate_to", "_start").alias("truncate_to"), F.coalesce("diverged_at_epoch", F.lit(0)).alias("diverged_at_epoch"))


def nack_backoff(attempt: Column, schedule: list[int], explicit: Column | None = None) -> Column:
    """Delay of a negative acknowledgement: by attempt, the last one from then on; explicit wins."""
    steps = F.array(*[F.lit(x).cast("long") for x in schedule])
    step = F.element_at(steps, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(schedule))).cast("int"))
    return F.coalesce(explicit, step) if explicit is not None else step


def drain_turns(records: DataFrame, lane: str) -> DataFrame:
    """Turn of each row when higher lanes of a log drain first, each in offset order.

    A row's turn is its place in its lane, counted along segments, after all rows of
    the higher lanes, which are one total a lane.
    """
    own = running(records, [*LOG, lane], "segment_id", "offset", F.lit(1).cast("long"), "sum", "_place")
    higher = W.partitionBy(*LOG).orderBy(F.desc(lane)).rowsBetween(W.unboundedPreceding, -1)
    totals = records.groupBy(*LOG, lane).agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).drop("_n")
    return own.join(totals, [*LOG, lane]).withColumn("turn", F.col("_place") + F.col("_above")).drop("_place", "_above")


def disposition(deliveries: Column, max_deliver: int) -> Column:
    """Dead-letter a message delivered more often than allowed; 0 allows any number."""
    return F.when((F.lit(max_deliver) != 0) & (deliveries > max_deliver), "dead_letter").otherwise("deliver")




def truncate_epochs(epochs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Epoch histories after their logs were cut at ``truncate_to``: entries from there on go."""
    j = epochs.join(cuts, LOG, "left")
    return j.filter(F.col("truncate_to").isNull() | (F.col("start_offset") < F.col("truncate_to"))).drop("truncate_to")


def dirty_run(records: DataFrame, segments: DataFrame, log: list[str], now_ms: int, tombstone_ttl: int, least_permille: int = 500, most: int = 8) -> DataFrame:
    """Segments that one compaction pass of each log takes, if the pass is worth it.

    ``segments``: log, segment_id, base, end, compacted. Sources are sealed (not the
    newest) and not compacted yet: from the lowest on, as long as each begins where
    the one before ended, 2 to ``most``. The pass is worth it if it drops enough of
    the run's rows. One row a segment is ordered; rows meet the chosen ones only.
    """
    w = W.partitionBy(*log).orderBy("base")
    s = segments.withColumn("_newest", F.max("segment_id").over(W.partitionBy(*log)))
    s = s.filter(~F.col("compacted") & (F.col("segment_id") < F.col("_newest")))
    torn = F.coalesce(F.col("base") != F.lag("end").over(w), F.lit(False)).cast("int")
    s = s.withColumn("_torn", torn).withColumn("_holes", F.sum("_torn").over(w)).withColumn("_i", F.row_number().over(w))
    s = s.filter((F.col("_holes") == 0) & (F.col("_i") <= most)).withColumn("_size", F.count(F.lit(1)).over(W.partitionBy(*log)))
    run = s.filter("_size >= 2").select(*log, "segment_id")
    rows = records.join(run, [*log, "segment_id"], "left_semi")
    kept = compact(rows, now_ms, tombstone_ttl, log).groupBy(*log).agg(F.count(F.lit(1)).alias("_kept"))
    sums = rows.groupBy(*log).agg(F.count(F.lit(1)).alias("total")).join(kept, log, "left")
    sums = sums.withColumn("dropped", F.col("total") - F.coalesce("_kept", F.lit(0))).drop("_kept")
    return run.join(sums.filter(F.col("dropped") * 1000 >= F.col("total") * least_permille), log)
