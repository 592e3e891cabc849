"""The scalar functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidelog.functions import names, sampling

#: name: parameters, result, body. Bodies are SQL, so the optimizer sees through them.
FUNCTIONS = {
    "tl_key_hash": ("k STRING", "BIGINT", "CAST(conv(substring(md5(encode(k, 'utf-8')), 1, 8), 16, 10) AS BIGINT)"),
    "tl_partition": ("k STRING, n INT", "BIGINT", "pmod(CAST(conv(substring(md5(encode(k, 'utf-8')), 1, 8), 16, 10) AS BIGINT), n)"),
    "tl_effective_ttl": ("message BIGINT, stream BIGINT", "BIGINT", "coalesce(least(nullif(message, 0), nullif(stream, 0)), 0)"),
    "tl_occupancy": ("rate DOUBLE, wait_us DOUBLE", "DOUBLE", "CASE WHEN NOT isnan(rate) AND NOT isnan(wait_us) AND rate >= 0 AND wait_us >= 0 AND rate < double('inf') AND wait_us < double('inf') THEN rate * (wait_us / 1000000) END"),
    "tl_segment_file": ("id BIGINT", "STRING", "concat('seg-', lpad(lower(hex(id)), 16, '0'), '.log')"),
    "tl_partition_folder": ("i BIGINT", "STRING", "concat('p-', lpad(lower(hex(i)), 8, '0'))"),
    "tl_cursor_file": ("g STRING", "STRING", "CASE WHEN g = '' THEN 'cursor.ckpt' ELSE concat('cursor-', lower(hex(encode(g, 'utf-8'))), '.ckpt') END"),
    "tl_is_error": ("code STRING", "BOOLEAN", f"CASE WHEN code IN ({', '.join(repr(c) for c in names.CODES)}) THEN startswith(code, 'ERR_') END"),
    "tl_fsync_admits": ("unsynced BIGINT, size BIGINT, headroom BIGINT", "BOOLEAN", "headroom = 0 OR unsynced = 0 OR unsynced + size <= headroom"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to ``spark.sql``; gives their names."""
    for name, (given, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
    spark.udf.register("tl_trace_position", sampling.position)
    return [*FUNCTIONS, "tl_trace_position"]
