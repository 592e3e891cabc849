"""Reading directories of binary segment files.

Files are listed and read by Spark's ``binaryFile`` source, so any store Spark
reaches will do; frames are decoded in Arrow batches, one file at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import SEGMENT_MAGIC, read_segment

RECORD = "path string, segment_id long, offset long, seq long, timestamp_ms long, flags int, key binary, headers binary, payload binary, subject string, stream_tag binary"
LOSS = "segment_id long, byte_offset_start long, byte_offset_end long, bytes_skipped long, reason string"
ROW = RECORD + ", " + ", ".join("loss_" + x for x in LOSS.split(", "))
CHUNK = 4096


def scan(spark: SparkSession, path: str, magic: bytes = SEGMENT_MAGIC) -> DataFrame:
    """Records of all ``seg-*.log`` files below a path, and one loss row a damaged file."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ROW.split(", ")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for rec, loss in read_segment(raw.as_buffer().to_pybytes(), magic):
                    rows.append({"path": file, **(rec or {}), **{"loss_" + k: v for k, v in (loss or {}).items()}})
                    if len(rows) == CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "seg-*.log").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(decode, ROW)


def records(scanned: DataFrame) -> DataFrame:
    return scanned.filter("offset is not null").select(*[x.split()[0] for x in RECORD.split(", ")])


def losses(scanned: DataFrame) -> DataFrame:
    return scanned.filter("loss_reason is not null").select("path", *[F.col("loss_" + x.split()[0]).alias(x.split()[0]) for x in LOSS.split(", ")])


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric samples of text exposition files: metric, labels, value."""
    line = F.col("value")
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(\S+)(?:\s+\d+)?$"
    t = spark.read.text(path).filter(~line.startswith("#") & line.rlike(pattern))
    body = F.regexp_replace(F.regexp_extract(line, pattern, 2), '"', "")
    return t.select(F.regexp_extract(line, pattern, 1).alias("metric"), F.when(body != "", F.str_to_map(body, F.lit(","), F.lit("="))).alias("labels"), F.regexp_extract(line, pattern, 3).try_cast("double").alias("sample"))
