"""Appending: offsets, labels, outcomes of a commit, and the choice of a partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.scan import ranked

LOG = ["stream", "partition"]


def append(rows: DataFrame, heads: DataFrame, order: str, width: int = 1 << 16) -> DataFrame:
    """Rows with the offsets they get behind the head of their log, dense in ``order``.

    ``order`` is a whole number, unique within a log; a log without a head begins at 0.
    """
    placed = ranked(rows, LOG, order, "_n", width).join(heads, LOG, "left")
    return placed.withColumn("offset", F.coalesce("head", F.lit(0)) + F.col("_n") - 1).drop("_n", "head")


def label_fault(subject: Column, tag: Column) -> Column:
    """A record has a subject or a stream tag, not both; null if that holds."""
    both = (F.coalesce(F.octet_length(subject), F.lit(0)) > 0) & (F.coalesce(F.octet_length(tag), F.lit(0)) > 0)
    return F.when(both, "subject_and_tag")


def commit_outcomes(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """What one commit did to each log: records appended, first offset and the next one.

    ``rows`` have their offsets. A log is ``rejected`` as a whole if its new offsets do
    not follow its head without a hole, ``unchanged`` if it got nothing.
    """
    got = rows.groupBy(*LOG).agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first"), F.max("offset").alias("_last"), F.count_distinct("offset").alias("_d"))
    j = heads.join(got, LOG, "full_outer").withColumn("head", F.coalesce("head", F.lit(0)))
    dense = (F.col("first") == F.col("head")) & (F.col("_last") - F.col("first") + 1 == F.col("_d")) & (F.col("_d") == F.col("records"))
    outcome = F.when(F.col("records").isNull(), "unchanged").when(dense, "committed").otherwise("rejected")
    done = outcome == "committed"
    return j.select(*LOG, outcome.alias("outcome"), F.when(done, F.col("records")).otherwise(0).alias("appended"), F.when(done, F.col("_last") + 1).otherwise(F.col("head")).alias("next_offset"))


def spread(rows: DataFrame, by: list[str], order: str, partitions: int, sticky: int = 1, width: int = 1 << 16) -> DataFrame:
    """Partitions for rows without a key, in turn, ``sticky`` rows at a time."""
    placed = ranked(rows, by, order, "_n", width)
    return placed.withColumn("partition", F.pmod(F.expr(f"(_n - 1) div {sticky}"), F.lit(partitions)).cast("int")).drop("_n")


def headroom(ceiling: Column, used: Column) -> Column:
    """Bytes left under a ceiling, never below 0; -1 without a ceiling (0) or a reading (null)."""
    return F.when((ceiling == 0) | used.isNull(), -1).otherwise(F.greatest(ceiling - used, F.lit(0)))


def headroom_permille(ceiling: Column, used: Column) -> Column:
    """The same in thousandths of the ceiling, rounded half up."""
    left, whole = F.greatest(ceiling - used, F.lit(0)).cast("decimal(20,0)"), ceiling.cast("decimal(20,0)")
    return F.when((ceiling == 0) | used.isNull(), -1).otherwise(F.call_function("div", left * 2000 + whole, whole * 2))


def fits(worst: list[Column], ceiling: Column) -> Column:
    """Whether all buffers at their worst stay under the ceiling; 0 is no ceiling."""
    total = sum((w.cast("decimal(38,0)") for w in worst[1:]), worst[0].cast("decimal(38,0)"))
    return (ceiling == 0) | (total <= ceiling)
