"""Monitoring queries over metric samples: rates, quantiles of histograms, alerts.

A sample is (series columns, ts in seconds, value). Windows run within a series.
Rates count resets as new beginnings; values are not extrapolated to the edges
of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def increase(samples: DataFrame, series: list[str], width: int) -> DataFrame:
    """Growth of each counter within tumbling windows of ``width`` seconds."""
    before = F.lag("value").over(W.partitionBy(*series).orderBy("ts"))
    grown = F.when(before.isNull(), 0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    s = samples.withColumn("_d", grown).withColumn("window", F.floor(F.col("ts") / width).cast("long") * width)
    return s.groupBy(*series, "window").agg(F.sum("_d").alias("increase"))


def rate(samples: DataFrame, series: list[str], width: int) -> DataFrame:
    return increase(samples, series, width).withColumn("rate", F.round(F.col("increase") / width, 9))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile of cumulative buckets (le, cumulative) by linear interpolation."""
    w = W.partitionBy(*by).orderBy("le")
    b = buckets.withColumn("_le0", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_c0", F.coalesce(F.lag("cumulative").over(w), F.lit(0)))
    b = b.withColumn("_all", F.max("cumulative").over(W.partitionBy(*by))).filter((F.col("cumulative") >= q * F.col("_all")) & (F.col("_all") > 0))
    first = b.groupBy(*by).agg(F.min(F.struct("le", "cumulative", "_le0", "_c0", "_all")).alias("f"))
    f = {c: F.col(f"f.{c}") for c in ("le", "cumulative", "_le0", "_c0", "_all")}
    inside = f["_le0"] + (f["le"] - f["_le0"]) * F.coalesce(F.try_divide(q * f["_all"] - f["_c0"], f["cumulative"] - f["_c0"]), F.lit(1.0))
    return first.select(*by, F.round(F.when(f["le"] == float("inf"), f["_le0"]).otherwise(inside), 6).alias("quantile"))


def ratio(a: DataFrame, b: DataFrame, on: list[str], value: str, floor: float = 1.0) -> DataFrame:
    """a over b, b at least ``floor``; series without a partner drop out."""
    j = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    return j.select(*on, F.round(F.col("_a") / F.greatest("_b", F.lit(floor)), 9).alias("ratio"))


def changes(samples: DataFrame, series: list[str], width: int) -> DataFrame:
    """How often a value changed within tumbling windows."""
    before = F.lag("value").over(W.partitionBy(*series).orderBy("ts"))
    s = samples.withColumn("_c", (before != F.col("value")).cast("int")).withColumn("window", F.floor(F.col("ts") / width).cast("long") * width)
    return s.groupBy(*series, "window").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"))


def held(samples: DataFrame, series: list[str], condition: Column, seconds: int) -> DataFrame:
    """Stretches in which a condition held at every sample for at least so long."""
    w = W.partitionBy(*series).orderBy("ts")
    s = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    s = s.withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    runs = s.filter("_on").groupBy(*series, "_run").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    return runs.filter(F.col("until") - F.col("since") >= seconds).drop("_run")


def top(samples: DataFrame, at: str, value: str, k: int, tie: str) -> DataFrame:
    """The k greatest values at each time; a bounded rank per time."""
    w = W.partitionBy(at).orderBy(F.desc(value), tie)
    return samples.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def latest(samples: DataFrame, series: list[str]) -> DataFrame:
    return samples.groupBy(*series).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def ungrounded(referenced: DataFrame, emitted: DataFrame) -> DataFrame:
    """Referenced metric names nobody emits, suffixes of histograms allowed."""
    stem = F.regexp_replace("metric", "_(bucket|sum|count)$", "")
    r = referenced.withColumn("_stem", stem)
    e = emitted.select(F.col("metric").alias("_name"))
    return r.join(e, (r["metric"] == e["_name"]), "left_anti").join(e, F.col("_stem") == e["_name"], "left_anti").select("metric")
