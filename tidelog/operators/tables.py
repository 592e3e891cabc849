"""Table-shaped operators: dead letters, transactions, idempotent appends, mirrors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.scan import ranked, running


def only_new(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the target does not hold: appending them twice changes nothing."""
    return rows.join(existing.select(*key).distinct(), key, "left_anti")


def redrive(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries of each group's dead letters at or past its redriven mark, in order."""
    placed = ranked(entries, ["group"], "source_offset", "_n").withColumn("pos", F.col("_n") - 1).drop("_n")
    return placed.join(marks, "group", "left").filter(F.col("pos") >= F.coalesce("redriven", F.lit(0))).drop("redriven")


def txn_state(half: DataFrame, ops: DataFrame) -> DataFrame:
    """Half messages with the first operation that resolved them, null while prepared."""
    first = ops.groupBy("txn_id").agg(F.min_by("op", "at").alias("op"))
    return half.join(first, "txn_id", "left")


def back_checks(open_txns: DataFrame, now: int, batch: int, max_attempts: int) -> DataFrame:
    """The most overdue open transactions, and whether this is their last check."""
    due = open_txns.filter(F.col("next_eligible") <= now).orderBy("next_eligible", "txn_id").limit(batch)
    return due.select("txn_id", "next_eligible", F.when(F.col("attempts") + 1 >= max_attempts, "terminal_default").otherwise("rescheduled").alias("outcome"))


def contiguity(sink: DataFrame) -> DataFrame:
    """Whether a table holds every offset between its ends exactly once."""
    s = sink.agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count(F.lit(1)).alias("rows"), F.count_distinct("offset").alias("_d"))
    return s.select("first", "last", "rows", (F.col("last") - F.col("first") + 1 == F.col("rows")).alias("contiguous"), (F.col("rows") == F.col("_d")).alias("no_duplicates"))


def fresh(records: DataFrame, next_offset: int) -> DataFrame:
    """What a sink has not taken yet; the mark is pushed down to the scan."""
    return records.filter(F.col("offset") >= next_offset)


def correlate(requests: DataFrame, replies: DataFrame, key: str, within: str) -> DataFrame:
    """Requests with the replies that carry their key within a time; none gives null."""
    r = replies.withColumnsRenamed({"at": "_at", key: "_key"})
    on = (requests[key] == r["_key"]) & (r["_at"] >= requests["at"]) & (r["_at"] < requests["at"] + F.expr(f"interval {within}"))
    return requests.join(r, on, "left")


def confirmations(produced: DataFrame, committed: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Whether each produced record was consumed, timed out, or is pending."""
    j = produced.join(committed, "stream", "left")
    late = (F.lit(ttl_ms) > 0) & (F.lit(now_ms) - F.col("timestamp_ms") >= ttl_ms)
    return j.withColumn("outcome", F.when(F.col("offset") < F.col("committed"), "consumed").when(late, "timed_out").otherwise("pending"))


def mirror(batches: DataFrame, cursor: int, anchor: int) -> DataFrame:
    """Accept source batches while each begins where the one before ended.

    ``batches``: first_offset, n, valid (rows before a corrupt one). Gives each
    batch's verdict and the rows to append, those below ``anchor`` left out.
    """
    w = W.partitionBy("stream").orderBy("first_offset")
    ended = F.coalesce(F.lag(F.col("first_offset") + F.col("n")).over(w), F.lit(cursor))
    b = batches.withColumn("_ok", F.col("first_offset") == ended).withColumn("_whole", F.coalesce(F.lag(F.col("valid") == F.col("n")).over(w), F.lit(True)))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("accepted", F.bool_and(F.col("_ok") & F.col("_whole")).over(run))
    rows = F.greatest(F.col("first_offset") + F.col("valid") - F.greatest("first_offset", F.lit(anchor)), F.lit(0))
    return b.select("stream", "first_offset", "accepted", F.when(F.col("accepted"), rows).otherwise(0).cast("long").alias("appended"))


def fan_in(origins: list[DataFrame], order: str, width: int = 1 << 16) -> DataFrame:
    """Several logs as one, with new dense offsets per target stream.

    ``order`` is a whole number, unique within an origin's stream; equal ones go by
    origin. Rows are numbered in blocks of ``width`` values of it.
    """
    every = reduce(DataFrame.unionByName, [o.withColumn("_origin", F.lit(k)) for k, o in enumerate(origins)])
    every = every.withColumn("_block", F.expr(f"`{order}` div {width}")).withColumn("_at", F.struct(order, "_origin"))
    numbered = running(every, ["stream"], "_block", "_at", F.lit(1).cast("long"), "sum", "_n")
    return numbered.withColumn("offset", F.col("_n") - 1).drop("_n", "_block", "_at", "_origin")
