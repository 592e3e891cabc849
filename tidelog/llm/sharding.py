"""Sharding by extendible hashing, without Python on the data path.

Each row has a 60-bit hash. A bucket is a hash prefix; it splits on one more bit
only while it holds more bytes than the limit. The shard of a row is the
shortest prefix of its hash whose bucket fits. The directory is a DataFrame
(one row per shard) and is never collected, so it may grow with the data.

Rounds: the hashes and byte counts of rows whose bucket is still too large are
summed at ``STEP`` more bits, partial sums first, and the sums at the bits in
between follow from those. Each round decides all buckets that fit; a round
reads only the 20 bytes a row of the table of hashes, not the texts. Nothing
depends on one key's size: a hot source, like any group of documents, is spread
over all prefixes by the hash of the row itself.

The hash is of doc_id and text. Rows alike in both share every prefix: they get
one shard, which may exceed the limit (``fits`` is false), as does the shard of
one document larger than the limit. A null text has 0 bytes; a null doc_id
counts as empty text. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import shared_table, text_col

BITS = 60
STEP = 6
LIMIT_BYTES = 1 << 20


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5 that any SQL engine can repeat."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), text)
    return F.conv(F.substring(F.md5(F.encode(key, "utf-8")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def shards(keys: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Rows with ``_h, _bytes`` -> also depth, prefix, shard_bytes, shard_rows, fits.

    ``keys`` is read once a round and should be a written table.
    """
    open_rows, found, depth = keys, [], 0
    while True:
        low, high = depth, min(depth + STEP, BITS)
        cells = open_rows.groupBy(_prefix(F.col("_h"), high).alias("_cell")).agg(F.sum("_bytes").alias("_b"), F.count(F.lit(1)).alias("_r"))
        # a cell counts in its prefix at every depth of this round
        each = cells.select("_cell", "_b", "_r", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        each = each.withColumn("prefix", F.expr(f"shiftright(_cell, {high} - depth)"))
        sums = each.groupBy("depth", "prefix").agg(F.sum("_b").alias("shard_bytes"), F.sum("_r").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS) | (F.col("shard_rows") == 1)
        best = each.join(sums, ["depth", "prefix"]).groupBy("_cell").agg(
            F.min(F.when(fits, F.struct("depth", "prefix", "shard_bytes", "shard_rows"))).alias("_at")
        )
        best = shared_table(best.select("_cell", "_at.*"), "directory")
        placed = open_rows.join(best.withColumnRenamed("_cell", "_c"), _prefix(F.col("_h"), high) == F.col("_c")).drop("_c")
        found.append(placed.filter(F.col("depth").isNotNull()))
        if high == BITS or not best.filter(F.col("depth").isNull()).limit(1).count():
            break
        open_rows = shared_table(placed.filter(F.col("depth").isNull()).select(*keys.columns), "open")
        depth = high + 1
    return reduce(DataFrame.unionByName, found).withColumn("fits", F.col("shard_bytes") <= limit)


def query(spark: SparkSession, sf_dir: str, limit: int = LIMIT_BYTES) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_col(docs)
    keys = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_hash(docs["doc_id"], text).alias("_h"), F.octet_length(text).cast("long").alias("_bytes"))
    out = shards(shared_table(keys, "hashes"), limit)
    return out.select(
        "doc_id",
        F.col("_bytes").alias("n_bytes"),
        F.substring(F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), BITS, "0"), F.lit(1), F.col("depth")).alias("shard"),
        F.col("depth").cast("long").alias("depth"),
        "shard_bytes",
        "shard_rows",
        "fits",
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), e AS (
  SELECT d.*, g.depth, h >> (60 - g.depth)::INT AS prefix FROM d, (SELECT unnest(range(0, 61))::BIGINT AS depth) g
), s AS (
  SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix)::BIGINT AS shard_bytes, count(*) OVER (PARTITION BY depth, prefix) AS shard_rows FROM e
)
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, depth::INT) AS shard, depth, shard_bytes, shard_rows, shard_bytes <= 1048576 AS fits
FROM s WHERE shard_bytes <= 1048576 OR depth = 60 OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) = 1
"""
