"""What a log serves to a reader, and what it answers when it cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.ordered import disposition
from tidelog.operators.reads import LOG, offset_window
from tidelog.operators.scan import islands
from tidelog.schema import GAP_TRIMMED


class UnknownStream(LookupError):
    """The stream was never opened; an opened stream without records reads as empty."""


class PartitionOutOfRange(LookupError):
    """The stream has no such partition."""


def flushed(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows below the flushed mark of their log; a log without a mark has flushed nothing."""
    return records.join(marks, LOG).filter(F.col("offset") < F.col("flushed")).drop("flushed")


def read(records: DataFrame, catalog: DataFrame, stream: str, partition: int, start: int, max_records: int, max_bytes: int) -> DataFrame:
    """A bounded read of one partition. ``catalog``: stream, partitions of all opened streams.

    The address is checked before the read: one row of the catalog comes to the driver.
    """
    known = catalog.filter(F.col("stream") == stream).select("partitions").first()
    if known is None:
        raise UnknownStream(stream)
    if not 0 <= partition < known[0]:
        raise PartitionOutOfRange(f"{stream}: {partition} of {known[0]}")
    return offset_window(records.filter((F.col("stream") == stream) & (F.col("partition") == partition)), start, max_records, max_bytes)


def addressed(requests: DataFrame, catalog: DataFrame, heads: DataFrame) -> DataFrame:
    """Many addresses at once: each request's status and how far the head lies beyond its start."""
    j = requests.join(catalog, "stream", "left").join(heads, LOG, "left")
    status = F.when(F.col("partitions").isNull(), "unknown_stream").when(~F.col("partition").between(0, F.col("partitions") - 1), "partition_out_of_range").otherwise("ok")
    left = F.greatest(F.coalesce("head", F.lit(0)) - F.col("start"), F.lit(0))
    return j.withColumn("status", status).withColumn("remaining", F.when(status == "ok", left)).drop("partitions", "head")


def trimmed_gaps(cursors: DataFrame, earliest: DataFrame) -> DataFrame:
    """What retention took from a reader: [cursor, earliest) with the reason's code."""
    j = cursors.join(earliest, LOG).filter(F.col("cursor") < F.col("earliest"))
    return j.select(*LOG, "group", F.col("cursor").alias("from"), F.col("earliest").alias("to"), F.lit(GAP_TRIMMED).alias("reason"))


def poll(cursors: DataFrame, bounds: DataFrame, max_deliver: int) -> DataFrame:
    """Outcome of a poll at each cursor, all kinds in one row shape.

    ``cursors``: log, group, cursor, deliveries of the record there; ``bounds``: log,
    earliest, head. A cursor below what is retained is told so before anything else.
    """
    j = cursors.join(bounds, LOG)
    below, done = F.col("cursor") < F.col("earliest"), F.col("cursor") >= F.col("head")
    parked = disposition(F.col("deliveries"), max_deliver) == "dead_letter"
    kind = F.when(below, "truncated").when(done, "idle").when(parked, "parked").otherwise("message")
    at = F.when(below, F.col("earliest")).when(~done, F.col("cursor"))
    return j.select(*LOG, "group", kind.alias("outcome"), at.alias("offset"), F.when(below, F.col("earliest") - F.col("cursor")).alias("skipped"))


def listing(streams: DataFrame) -> DataFrame:
    """Names of all streams with their places: the unnamed default first, then by name.

    One row a stream, so one task orders them.
    """
    every = streams.select("stream").unionByName(streams.sparkSession.range(1).select(F.lit("").alias("stream"))).distinct()
    return every.select("stream", (F.row_number().over(W.orderBy(F.col("stream") != "", "stream")) - 1).alias("place"))


def attempts(deliveries: DataFrame, order: str) -> DataFrame:
    """Number of each delivery of an offset to a group, from 1."""
    return deliveries.withColumn("attempt", F.row_number().over(W.partitionBy("group", "offset").orderBy(order)))


def ack_state(offsets: DataFrame, acks: DataFrame, base: int = 0, width: int = 1000) -> DataFrame:
    """Whether each (group, offset) is committed, acknowledged ahead of the cursor, or open.

    Runs of acknowledged offsets are looked up by range: a run is listed under every
    block of ``width`` offsets it touches, so a lookup meets the runs of one block only.
    """
    runs = islands(acks.filter(F.col("offset") >= base), ["group"], "offset")
    block = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    runs = runs.select(F.col("group").alias("_g"), "start", "end", block.alias("_b"))
    on = (F.col("group") == F.col("_g")) & (F.expr(f"offset div {width}") == F.col("_b")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    state = F.when((F.col("offset") < base) | (F.col("start") == base), "committed").when(F.col("start").isNotNull(), "ahead").otherwise("open")
    return offsets.join(runs, on, "left").withColumn("state", state).drop("_g", "_b", "start", "end")


def paused_deadlines(leases: DataFrame, pauses: DataFrame) -> DataFrame:
    """Deadlines of leases after a pause of their group: the clock stands still meanwhile.

    ``leases``: group, granted, deadline; ``pauses``: group, from, to, one a group. A
    lease in flight when the pause begins, or granted within it, gets the rest of the span.
    """
    j = leases.join(pauses, "group", "left")
    hit = (F.col("deadline") > F.col("from")) & (F.col("granted") < F.col("to"))
    span = F.col("to") - F.greatest("from", "granted")
    return j.withColumn("deadline", F.col("deadline") + F.when(hit, span).otherwise(0)).drop("from", "to")


def expired(leases: DataFrame, now: int) -> DataFrame:
    """Leases whose deadline has come; the deadline itself counts."""
    return leases.filter(F.col("deadline") <= now)


def purge(records: DataFrame, streams: DataFrame) -> DataFrame:
    """Rows of all streams but the named ones; offsets of what stays do not move."""
    return records.join(streams.select("stream").distinct(), "stream", "left_anti")


def prune_dead_letters(entries: DataFrame, floors: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Dead letters at or past their group's floor; forgotten groups lose all of theirs."""
    kept = entries.join(forgotten.select("group").distinct(), "group", "left_anti").join(floors, "group", "left")
    return kept.filter(F.col("source_offset") >= F.coalesce("floor", F.lit(0))).drop("floor")


def changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two recoveries of a log do not share, with how many more the left one has.

    One aggregation instead of two set differences; no row means the two are equal.
    """
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    net = both.groupBy(*left.columns).agg(F.sum("_n").alias("surplus"))
    return net.filter("surplus <> 0")


def scaled(value: Column, unit: float) -> Column:
    """A count in larger units, for a panel."""
    return value / F.lit(unit)
