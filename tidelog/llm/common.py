"""Shared helpers of the training-data operators: text views, hashing, shared tables.

Conventions used by every operator here:

* a null text is an empty text; a null ``doc_id`` is kept and travels through;
* columns that an operator does not know are ignored, its own columns are
  computed under names of its own before any join, so clashing names are safe;
* an intermediate table that a later step reads twice is written as Parquet
  below ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
  executor costs a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: blank and the control characters tab to CR.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session within one machine may do without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before the interpreter
            pass


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`shared_table` that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = f.rsplit("/", 1)[0]
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only dead DataFrames refer to.

    Spark drops them when the driver's collector finds their owners dead. Between
    the steps of a long operator that may come too late for the executors' disks;
    nothing but the time of the clean-up depends on this call.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks_for(spark: SparkSession) -> int:
    """Partitions of a shuffle: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_col(df: DataFrame, name: str = "text"):
    return F.coalesce(df[name].cast("string"), F.lit(""))


def id_crc(col):
    """crc32 of the id as text, unsigned; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "utf-8"))


# ---------------------------------------------------------------- numpy hashing

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of uint64."""
    x = x + M1
    x = (x ^ (x >> _S30)) * M2
    x = (x ^ (x >> _S27)) * M3
    return x ^ (x >> _S31)


def to_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket, stable, and where each bucket's begin in it."""
    to = (mix(keys) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    return np.argsort(to, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(to, minlength=buckets))])


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    while len(have) < n:
        step = np.uint64(pow(int(_BASE if which == "b" else _BASE_INV), len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[which] = have
    return have[:n]


class Rolling:
    """Polynomial prefix hashes of bytes, or of 64-bit hashes; any span's hash in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * _power("b", n), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of data[start:end], also of their lengths."""
        inv = _power("i", self.n + 1)
        h = (self.sums[end] - self.sums[start]) * inv[start]
        return mix(h ^ ((end - start).astype(np.uint64) * M2))


_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a byte array."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _IS_WS[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and 64-bit hashes of a byte array."""
    s, e = word_bounds(data)
    return s, e, Rolling(data).spans(s, e)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words, from the words' hashes."""
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h * M2 + words[k : k + m])
    return h


def as_bytes(text: str | bytes | None) -> np.ndarray:
    if text is None:
        return np.zeros(0, np.uint8)
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8)


class Joined:
    """Texts of a batch as one byte string, a line feed between them."""

    def __init__(self, texts: list[bytes | None], lowered: bool = False):
        raw = b"\n".join([x or b"" for x in texts])
        self.data = np.frombuffer(raw, np.uint8)
        if lowered:
            self.data = lower(self.data)
        sizes = np.fromiter((len(x) if x else 0 for x in texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.sizes = sizes

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ends, hashes, and the number of words of each text."""
        s, e, h = word_hashes(self.data)
        cut = np.searchsorted(s, np.append(self.starts, len(self.data) + 1))
        return s, e, h, np.diff(cut)


def pieces(batches, names: list[str], text: str, limit: int = 1 << 22):
    """Cut Arrow batches into runs of rows of about ``limit`` text bytes."""
    import pyarrow as pa

    for batch in batches:
        cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
        t = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut, total = [0], np.cumsum(sizes + 64)
        while cut[-1] < len(sizes):
            base = total[cut[-1] - 1] if cut[-1] else 0
            cut.append(max(cut[-1] + 1, int(np.searchsorted(total, base + limit))))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield {n: c.slice(a, b - a) for n, c in cols.items()}, t.slice(a, b - a).to_pylist()
