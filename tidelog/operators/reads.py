"""Reads: windows by offset, time and size; gaps; expiry; delayed visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.scan import islands, running

LOG = ["stream", "partition"]


def offset_window(records: DataFrame, start: int, max_records: int, max_bytes: int) -> DataFrame:
    """Per log, from ``start`` on, at most so many records and bytes, but always one.

    Segments are counted first, one row each. Only those in which the window can
    still be open are read for rows, so a small window of a long log stays small.
    """
    df = records.filter(F.col("offset") >= start)
    held = df.groupBy(*LOG, "segment_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.octet_length("payload")).alias("_size"))
    before = W.partitionBy(*LOG).orderBy("segment_id").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("_r", F.sum("_rows").over(before)).withColumn("_s", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    open_ = held.filter(F.col("_r").isNull() | (F.col("_r") < max_records) & (F.col("_s") <= max_bytes)).select(*LOG, "segment_id")
    df = df.join(open_, [*LOG, "segment_id"], "left_semi").withColumn("_len", F.octet_length("payload").cast("long"))
    df = running(df, LOG, "segment_id", "offset", F.lit(1), "sum", "_n")
    df = running(df, LOG, "segment_id", "offset", F.col("_len"), "sum", "_bytes")
    return df.filter((F.col("_n") == 1) | (F.col("_n") <= max_records) & (F.col("_bytes") <= max_bytes)).drop("_n", "_bytes", "_len")


def seek_by_time(records: DataFrame, start_ms: int, end_ms: int = 0) -> DataFrame:
    """From the first offset at or after ``start_ms`` up to the first at or after ``end_ms``.

    Offsets decide, not times: once begun, earlier timestamps are delivered too.
    0 leaves a bound open. Minima are partial sums; rows are read once more.
    """
    begin = F.min(F.when(F.col("timestamp_ms") >= start_ms, F.col("offset")))
    bounds = records.groupBy(*LOG).agg(begin.alias("_from"))
    df = records.join(bounds, LOG).filter(F.col("offset") >= F.col("_from"))
    if end_ms:
        stop = df.filter(F.col("timestamp_ms") >= end_ms).groupBy(*LOG).agg(F.min("offset").alias("_to"))
        df = df.join(stop, LOG, "left").filter(F.col("_to").isNull() | (F.col("offset") < F.col("_to"))).drop("_to")
    return df.drop("_from")


def effective_ttl(message: Column, stream: Column) -> Column:
    """The lower of two lifetimes; 0 means without end."""
    low = F.least(F.nullif(message, F.lit(0)), F.nullif(stream, F.lit(0)))
    return F.coalesce(low, F.lit(0))


def live(records: DataFrame, now_ms: int, stream_ttl: int = 0) -> DataFrame:
    """Rows that have not expired: expiry is inclusive, lifetime 0 never ends."""
    ttl = effective_ttl(F.col("ttl_ms"), F.lit(stream_ttl).cast("long"))
    return records.filter((ttl == 0) | (F.col("timestamp_ms") + ttl > now_ms))


def due_prefix(records: DataFrame, now_ms: int) -> DataFrame:
    """Rows before the first one that is not due; log order holds, later due rows wait."""
    held = records.filter(F.col("due_ms") > now_ms).groupBy(*LOG).agg(F.min("offset").alias("_hold"))
    return records.join(held, LOG, "left").filter(F.col("_hold").isNull() | (F.col("offset") < F.col("_hold"))).drop("_hold")


def truncated(cursors: DataFrame, earliest: DataFrame) -> DataFrame:
    """Cursors below the earliest retained offset move there; the distance was skipped."""
    j = cursors.join(earliest, LOG)
    return j.select(*LOG, "group", F.greatest("cursor", "earliest").alias("from"), F.greatest(F.col("earliest") - F.col("cursor"), F.lit(0)).alias("skipped"))


def dense_positions(records: DataFrame) -> DataFrame:
    """Position of each record in its own stream, from 0, in a log shared by many."""
    df = running(records, ["stream"], "segment_id", "offset", F.lit(1).cast("long"), "sum", "_n")
    return df.withColumn("position", F.col("_n") - 1).drop("_n")


def filtered_gaps(window: DataFrame, keep: Column) -> DataFrame:
    """Runs of rows that a filtered consumer skips, as [from, to) with bytes and count.

    A run ends where a kept row stands between; runs are numbered by the kept rows
    before them, which is a running sum along segments.
    """
    df = window.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    df = running(df, LOG, "segment_id", "offset", F.when(F.col("_keep"), 1).otherwise(0), "sum", "_run")
    gaps = df.filter(~F.col("_keep")).groupBy(*LOG, "_run").agg(F.min("offset").alias("from"), (F.max("offset") + 1).alias("to"), F.sum(F.octet_length("payload")).alias("bytes_skipped"), F.count(F.lit(1)).alias("records"))
    return gaps.drop("_run")


def sparse_gaps(records: DataFrame) -> DataFrame:
    """Holes between neighbouring offsets of a log, as [from, to).

    The next offset is found within a segment, or is the first of the next one.
    """
    w = W.partitionBy(*LOG, "segment_id").orderBy("offset")
    heads = records.groupBy(*LOG, "segment_id").agg(F.min("offset").alias("_first"))
    heads = heads.withColumn("_next", F.lead("_first").over(W.partitionBy(*LOG).orderBy("segment_id"))).drop("_first")
    df = records.select(*LOG, "segment_id", "offset").withColumn("_lead", F.lead("offset").over(w)).join(heads, [*LOG, "segment_id"])
    df = df.withColumn("to", F.coalesce("_lead", "_next")).filter(F.col("to") > F.col("offset") + 1)
    return df.select(*LOG, (F.col("offset") + 1).alias("from"), "to")


def ack_cursor(acks: DataFrame, base: int = 0) -> DataFrame:
    """Per group: the first offset not acknowledged, and the runs beyond it."""
    runs = islands(acks.filter(F.col("offset") >= base), ["group"], "offset")
    first = runs.filter(F.col("start") == base).select("group", F.col("end").alias("committed"))
    j = runs.join(first, "group", "left").withColumn("committed", F.coalesce("committed", F.lit(base)))
    out = j.groupBy("group").agg(F.max("committed").alias("_c"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_all"))
    return out.select("group", F.col("_c").alias("committed"), F.filter("_all", lambda r: r["start"] >= F.greatest(F.col("_c"), F.lit(base + 1))).alias("ahead"))
