"""Summaries of streams, groups, losses, latencies, and the regression gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.schema import HARMLESS_REASON, LOSS_REASONS


def stream_summary(records: DataFrame) -> DataFrame:
    """Earliest offset, head (one past the last) and records of each stream."""
    return records.groupBy("stream").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("head"), F.count(F.lit(1)).alias("records"))


def group_lag(cursors: DataFrame, heads: DataFrame) -> DataFrame:
    """Lag of each group behind its stream's head, and whether its cursor lies in the log."""
    j = cursors.join(heads, "stream")
    return j.select("stream", "group", "committed", F.greatest(F.col("head") - F.col("committed"), F.lit(0)).alias("lag"), ((F.col("committed") >= F.col("earliest")) & (F.col("committed") <= F.col("head"))).alias("in_range"))


def fold_overflow(per_key: DataFrame, key: str, first_seen: str, value: str, cap: int, other: str) -> DataFrame:
    """Sums by key; keys beyond the first ``cap`` ever seen share one line.

    The cut is the ``cap``-th smallest first-seen mark, found by a bounded top-k,
    so no window runs over all keys.
    """
    top = per_key.orderBy(first_seen, key).limit(cap).select(key, F.lit(True).alias("_own"))
    j = per_key.join(F.broadcast(top), key, "left")
    label = F.when(F.col("_own"), F.col(key).cast("string")).otherwise(other)
    return j.groupBy(label.alias(key)).agg(F.sum(value).alias(value))


def histogram(df: DataFrame, by: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative counts per bucket (upper bounds inclusive, last is +Inf), count and sum."""
    aggs = [F.count_if(value <= b).alias(f"le_{k}") for k, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*aggs, F.count(value).alias("count"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{k}").alias("cumulative")) for k, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative")))
    return wide.select(*by, F.explode(F.array(*rows)).alias("b"), "count", "total").select(*by, "b.le", "b.cumulative", "count", "total")


def loss_report(losses: DataFrame) -> DataFrame:
    """Bytes and records lost by reason; every reason has a line."""
    spark = losses.sparkSession
    names = spark.createDataFrame(list(LOSS_REASONS.items()), "reason_code int, reason string")
    sums = losses.groupBy("reason_code").agg(F.sum("bytes_skipped").alias("bytes"), F.sum("records_lost_estimate").alias("records"), F.count(F.lit(1)).alias("events"))
    j = F.broadcast(names).join(sums, "reason_code", "left")
    return j.select("reason_code", "reason", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes", "records", "events")], (F.col("reason") != HARMLESS_REASON).alias("is_data_loss"))


def loss_caps(losses: DataFrame, durable_bytes: Column, per_event: int) -> DataFrame:
    """First violated bound: one event's bytes, or a hundredth of the durable bytes for all."""
    s = losses.agg(F.max("bytes_skipped").alias("largest"), F.sum("bytes_skipped").alias("total"))
    cap = F.expr(f"{durable_bytes} div 100") if isinstance(durable_bytes, str) else durable_bytes
    s = s.withColumn("cap", cap)
    return s.select("largest", "total", "cap", F.when(F.col("largest") > per_event, "per_event").when(F.col("total") > F.col("cap"), "global").otherwise("ok").alias("verdict"))


def percentiles(df: DataFrame, by: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """p50, p99, p999 and the maximum of each group.

    Exact, with interpolation, unless ``accuracy`` is given: exact ones keep a count
    for each distinct value of a group, approximate ones a sketch of bounded size
    whose ranks are off by at most 1/accuracy of the group's rows.
    """
    ranks = F.array(F.lit(0.5), F.lit(0.99), F.lit(0.999))
    p = F.percentile(value, ranks) if accuracy is None else F.percentile_approx(value, ranks, accuracy)
    out = df.groupBy(*by).agg(p.alias("_p"), F.max(value).alias("max"))
    return out.select(*by, *[F.round(F.get("_p", F.lit(k)), 6).alias(n) for k, n in enumerate(("p50", "p99", "p999"))], "max")


def occupancy(rate: Column, wait_us: Column) -> Column:
    """Rate times wait, in messages; null for what is negative or not a number."""
    bad = F.isnan(rate) | F.isnan(wait_us) | (rate < 0) | (wait_us < 0) | (rate == float("inf")) | (wait_us == float("inf"))
    return F.when(~bad, rate * (wait_us / 1_000_000.0))


def regression_gate(current: DataFrame, baseline: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Per device: medians now and before, and which limits are broken."""
    metrics = ("throughput", "p99", "p999")
    cur = current.filter(F.col("warmup_ok") & F.col("unix_secs").between(now - days * 86_400, now))

    def med(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("device").agg(*[F.median(m).alias(f"{m}_{tag}") for m in metrics])

    j = med(cur, "now").join(med(baseline.filter("warmup_ok"), "base"), "device")
    change = {m: F.try_divide(F.col(f"{m}_now") - F.col(f"{m}_base"), F.col(f"{m}_base")) for m in metrics}
    broken = {"throughput": -change["throughput"] > 0.10, "p99": change["p99"] > 0.15, "p999": change["p999"] > 0.25}
    flags = [F.coalesce((F.col(f"{m}_base") > 0) & broken[m], F.lit(False)).alias(f"{m}_breach") for m in metrics]
    verdict = F.when(reduce(lambda a, b: a | b, [F.col(f"{m}_breach") for m in metrics]), "fail").otherwise("pass")
    return j.select("device", *flags).withColumn("outcome", verdict)


def gate_outcome(current: DataFrame, baseline: DataFrame, now: int, days: int = 7, ratified: str | None = None) -> DataFrame:
    """The whole gate's outcome, one row.

    ``no_baseline``: no run to compare with; ``insufficient_data``: no run of the
    window that was warmed up; else ``pass``, or with a device over a limit ``fail``,
    or ``ratified`` if somebody gave a reason to accept it.
    """
    some = F.coalesce(F.count(F.lit(1)) > 0, F.lit(False)).alias("some")
    old = baseline.agg(some.alias("had"))
    new = current.filter(F.col("warmup_ok") & F.col("unix_secs").between(now - days * 86_400, now)).agg(some.alias("has"))
    broken = regression_gate(current, baseline, now, days).agg(F.count_if(F.col("outcome") == "fail").alias("broken"))
    outcome = F.when(~F.col("had"), "no_baseline").when(~F.col("has"), "insufficient_data").when(F.col("broken") == 0, "pass").otherwise("ratified" if ratified else "fail")
    # one row each
    return old.join(new).join(broken).select(outcome.alias("outcome"), "broken")


def latest_then_median(rows: DataFrame, cell: list[str], run: list[str], order: str, value: str) -> DataFrame:
    """Last write of each run, then the median of each cell; nulls do not count."""
    last = rows.groupBy(*cell, *run).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(*cell).agg(F.round(F.median("_v"), 6).alias("median"), F.count("_v").alias("n"))


def quota(usage: DataFrame, quotas: DataFrame) -> DataFrame:
    """Streams and bytes of each tenant against its limits; 0 means no limit."""
    used = usage.groupBy("tenant").agg(F.count_distinct("stream").alias("streams"), F.sum("bytes").alias("bytes"))
    over = (F.col("max_streams") != 0) & (F.col("streams") > F.col("max_streams")) | (F.col("max_bytes") != 0) & (F.col("bytes") > F.col("max_bytes"))
    return used.join(quotas, "tenant").select("tenant", "streams", "bytes", over.alias("over"))


