"""Log tables derived from the supplied tables, by arithmetic any SQL engine repeats.

``SQL`` holds the same derivations as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NOW_MS = 1_705_276_800_000  # 2024-01-15, inside the events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records, with times out of order, keyless rows and tombstones."""
    e = table(spark, sf_dir, "events")
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("ev-"), "event_type").alias("stream"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        i.alias("offset"),
        (i % 1000).alias("seq"),
        F.expr("event_id div 1000").alias("segment_id"),
        (ms - (i % 5) * 60_000).alias("timestamp_ms"),
        F.when(i % 11 == 0, "").otherwise(F.col("user_id").cast("string")).alias("key"),
        F.concat(F.lit("ev."), "event_type", F.lit(".u"), F.col("user_id").cast("string")).alias("subject"),
        F.when(i % 13 == 0, "").otherwise(F.col("props")).alias("payload"),
        F.when(i % 4 == 0, 0).otherwise((i % 4) * DAY_MS).cast("long").alias("ttl_ms"),
        (ms + (i % 17) * 3_600_000).alias("due_ms"),
        F.col("user_id"),
        F.col("value"),
        F.col("event_type"),
    )


SQL = {
    "rec": """rec AS (
  SELECT 'ev-' || event_type AS stream, (user_id % 4)::INT AS "partition", event_id AS "offset", event_id % 1000 AS seq,
         event_id // 1000 AS segment_id, epoch_us(ts) // 1000 - (event_id % 5) * 60000 AS timestamp_ms,
         CASE WHEN event_id % 11 = 0 THEN '' ELSE user_id::VARCHAR END AS key,
         'ev.' || event_type || '.u' || user_id AS subject, CASE WHEN event_id % 13 = 0 THEN '' ELSE props END AS payload,
         CASE WHEN event_id % 4 = 0 THEN 0 ELSE (event_id % 4) * 86400000 END AS ttl_ms,
         epoch_us(ts) // 1000 + (event_id % 17) * 3600000 AS due_ms, user_id, value, event_type
  FROM events)""",
}
