"""Report tables over metric samples: (metric, labels, sample), one row a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = {"committed": "group_committed_offset", "lag": "group_consumer_lag", "in_flight": "group_in_flight", "consumed": "group_consumed_total"}
STREAMS = {"produced": "stream_produced_total"}
CONNECTIONS = {"connections": "connections_total"}
REJECTED = {"rejected": "connections_rejected_total"}
LOSS = {"bytes": "recovery_loss_bytes"}
STORAGE = {
    "segments": "segment_count",
    "durable_bytes": "durable_record_bytes",
    "disk_free": "disk_free_bytes",
    "ram_headroom": "ram_headroom_bytes",
    "logical_written": "logical_bytes_written",
    "physical_written": "physical_bytes_written",
}
RECOVERY = {
    "writer_healthy": "writer_healthy",
    "runs": "recovery_runs_total",
    "truncated_bytes": "recovery_truncated_bytes",
    "records_skipped": "records_skipped",
    "bytes_skipped": "bytes_skipped",
    "last_skip_offset": "last_skip_offset",
    "truncations": "truncations_total",
    "truncated_records": "truncated_records_total",
    "quarantine_bytes": "quarantine_bytes",
}
UNKNOWN_BELOW_ZERO = ("disk_free", "ram_headroom")


def _pick(columns: dict[str, str]):
    return [F.coalesce(F.max(F.when(F.col("metric") == m, F.col("sample"))), F.lit(0)).cast("long").alias(c) for c, m in columns.items()]


def by_label(samples: DataFrame, label: str, columns: dict[str, str], contains: str | None = None) -> DataFrame:
    """A row for each value of a label, a column for each metric, 0 where a series is missing."""
    mine = samples.filter(F.col("metric").isin(*columns.values())).withColumn(label, F.coalesce(F.col("labels")[label], F.lit("")))
    if contains:
        mine = mine.filter(F.col(label).contains(contains))
    return mine.groupBy(label).agg(*_pick(columns))


def single(samples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row of unlabelled metrics; a negative reading of a free space means that it is not known."""
    row = samples.filter(F.col("metric").isin(*columns.values())).agg(*_pick(columns))
    return row.select(*[F.when(F.col(c) >= 0, F.col(c)).alias(c) if c in UNKNOWN_BELOW_ZERO else c for c in columns])


def groups(samples: DataFrame, contains: str | None = None) -> DataFrame:
    return by_label(samples, "group", GROUPS, contains)


def streams(samples: DataFrame, contains: str | None = None) -> DataFrame:
    return by_label(samples, "stream", STREAMS, contains)


def storage(samples: DataFrame) -> DataFrame:
    """With the ratio of bytes written to bytes asked for, null before the first write."""
    s = single(samples, STORAGE)
    return s.withColumn("write_amp", F.col("physical_written") / F.nullif("logical_written", F.lit(0)))


def recovery(samples: DataFrame) -> DataFrame:
    s = single(samples, RECOVERY)
    return s.withColumn("writer_healthy", F.col("writer_healthy") == 1)


def losses(samples: DataFrame) -> DataFrame:
    return by_label(samples, "reason", LOSS).filter("bytes > 0")


def connections(samples: DataFrame) -> DataFrame:
    return by_label(samples, "state", CONNECTIONS)


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column, null left out; columns are counted in one pass."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])
