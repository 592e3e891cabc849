"""Helpers for running values over long logs, cut at segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, log: list[str], segment: str, order: str, value: Column, fold: str, name: str, *, inclusive: bool = True) -> DataFrame:
    """Running sum or max of ``value`` along each log, without one task per log.

    A plain window over a log sorts the whole log in one task. Here the window
    runs within segments; the totals of segments, one row each, carry over.
    """
    agg: Callable[[Column], Column] = {"sum": F.sum, "max": F.max}[fold]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}[fold]
    rows = W.partitionBy(*log, segment).orderBy(order)
    rows = rows.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    base = df.withColumn("_v", value)
    totals = base.groupBy(*log, segment).agg(agg("_v").alias("_t"))
    before = W.partitionBy(*log).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", agg("_t").over(before)).drop("_t")
    return base.withColumn("_own", agg("_v").over(rows)).join(totals, [*log, segment], "left").withColumn(name, join(F.col("_own"), F.col("_before"))).drop("_v", "_own", "_before")


def islands(df: DataFrame, log: list[str], order: str, width: int = 1 << 16) -> DataFrame:
    """Merge rows of consecutive ``order`` values into (log..., start, end) ranges, end exclusive.

    Ranges form within blocks of ``width`` values. Only those that reach a block's
    edge, two a block at most, are then put in order along the log to be joined up.
    """
    w = W.partitionBy(*log, "_b").orderBy(order)
    g = df.select(*log, order).distinct().withColumn("_b", F.expr(f"`{order}` div {width}"))
    g = g.withColumn("_g", F.col(order) - F.row_number().over(w))
    runs = g.groupBy(*log, "_b", "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_b", "_g")
    edge = (F.col("start") % width == 0) | (F.col("end") % width == 0)
    along = W.partitionBy(*log).orderBy("start")
    cut = runs.filter(edge).withColumn("_new", (F.col("start") != F.coalesce(F.lag("end").over(along), F.lit(-1))).cast("int"))
    cut = cut.withColumn("_k", F.sum("_new").over(along))
    whole = cut.groupBy(*log, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_k")
    return runs.filter(~edge).unionByName(whole)


def ranked(df: DataFrame, log: list[str], order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Number rows along each log from 1 by a whole-number ``order``, in blocks of ``width`` values."""
    blocks = df.withColumn("_block", F.expr(f"`{order}` div {width}"))
    return running(blocks, log, "_block", order, F.lit(1).cast("long"), "sum", name).drop("_block")
