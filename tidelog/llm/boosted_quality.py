"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text gives some 26 statistics of its bytes, words, lines, repetitions and
compressibility. Trees of fixed depth are grown on binned statistics with
second-order logistic gradients and flattened into arrays in heap order (children
of node i at 2i+1 and 2i+2), so scoring is a few indexed numpy steps a level for
a whole batch.

The labels to learn from are a bounded sample: the TRAIN_ROWS labelled rows with
the smallest hashes (all of them if fewer). Only those rows' statistics reach
the driver, never texts. Labels, lang, source and doc_id are no statistics.

Null or empty text: all statistics 0, scored like any other. Several labels of
one document are averaged; null labels are left out; without labels, or with one
class only, every score is the share of good labels, 0.5 if none. Repeated rows
get equal scores. Empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Joined, Rolling, id_crc, mix, pieces, text_col

TRAIN_ROWS = 30_000
TREES = 120
DEPTH = 4
BINS = 64
RATE = 0.12
LAMBDA = 2.0
LEAST_ROWS = 12

# ------------------------------------------------------------- the statistics

_CLASSES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?'\"-()",
    "shout": b"!",
    "mark": b"#*$%&",
    "table": b"|<>",
    "other": bytes(set(range(128)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \t\r\x0b\x0c\n.,;:?'\"-()!#*$%&|<>")),
    "high": bytes(range(128, 256)),
}
STATS = [*_CLASSES, "bytes", "words", "word_len", "word_dev", "word_max", "ends_mark", "capital", "distinct", "twin2", "twin5", "lines", "line_len", "line_dup", "ratio", "stop_gap"]


def _per_doc(cut: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive cuts."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[cut[1:]] - total[cut[:-1]]


def _repeats(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each document, how many keys equal an earlier one of the same document."""
    _, first = np.unique(mix(keys ^ mix(doc.astype(np.uint64))), return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of statistics a text, in the order of STATS."""
    n = len(texts)
    j = Joined(texts)
    data, ends = j.data, j.starts + j.sizes
    out: dict[str, np.ndarray] = {}
    size = j.sizes.astype(np.float64)
    safe = np.maximum(size, 1)
    cut2 = np.stack([j.starts, ends])
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        total = np.concatenate([[0], np.cumsum(table[data])])
        out[name] = (total[cut2[1]] - total[cut2[0]]) / safe
    s, e, h, counts = j.words()
    cut = np.concatenate([[0], np.cumsum(counts)])
    words = np.maximum(counts, 1)
    doc = np.repeat(np.arange(n), counts)
    length = (e - s).astype(np.float64)
    mean = _per_doc(cut, length) / words
    out["bytes"], out["words"] = np.log1p(size), np.log1p(counts)
    out["word_len"] = mean
    out["word_dev"] = np.sqrt(np.maximum(_per_doc(cut, length**2) / words - mean**2, 0))
    longest = np.zeros(n)
    if len(doc):
        np.maximum.at(longest, doc, length)
    out["word_max"] = np.log1p(longest)
    final = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    out["ends_mark"] = _per_doc(cut, np.isin(final, list(b"#*$%&!|<>")).astype(float)) / words
    head = data[s] if len(s) else np.zeros(0, np.uint8)
    out["capital"] = _per_doc(cut, ((head >= 65) & (head <= 90)).astype(float)) / words
    out["stop_gap"] = _per_doc(cut, np.isin(final, list(b".?!")).astype(float)) / words
    out["distinct"] = _repeats(doc, h, n) / words
    for k in (2, 5):
        if len(h) >= k:
            m = len(h) - k + 1
            g = h[:m]
            for i in range(1, k):
                g = mix(g * np.uint64(0xBF58476D1CE4E5B9) + h[i : i + m])
            inside = doc[:m] == doc[k - 1 :]
            out[f"twin{k}"] = _repeats(doc[:m][inside], g[inside], n) / words
        else:
            out[f"twin{k}"] = np.zeros(n)
    marks = np.flatnonzero(np.append(data == 10, True))
    begins = np.concatenate([[0], marks[:-1] + 1])
    line_doc = np.searchsorted(j.starts, begins, side="right") - 1
    if n:
        full = marks > begins
        lines = np.bincount(line_doc[full], minlength=n)
        out["lines"], out["line_len"] = np.log1p(lines), np.log1p(size / np.maximum(lines, 1))
        hashed = Rolling(data).spans(begins[full], marks[full])
        out["line_dup"] = _repeats(line_doc[full], hashed, n) / np.maximum(lines, 1)
    else:
        out["lines"] = out["line_len"] = out["line_dup"] = np.zeros(0)
    packer = zstandard.ZstdCompressor(level=1)
    out["ratio"] = np.array([len(packer.compress(t)) / len(t) if t else 0.0 for t in texts])
    return np.stack([out[name] for name in STATS], axis=1) if n else np.zeros((0, len(STATS)))


# ------------------------------------------------------------------ the model


@dataclass
class Forest:
    """Trees as arrays: [tree, inner node] and [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (len(leaf) - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Grow the trees level by level from histograms of gradients."""
    share = float(y.mean()) if len(y) else 0.5
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99)
        none = np.zeros((0, inner))
        return Forest(none.astype(np.int64), none, np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(m) * BINS
    margin = np.full(n, np.log(share / (1 - share)))
    start = float(margin[0])
    fs, ts, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            at = (node - first)[:, None] * (m * BINS) + flat
            shape, size = (width, m, BINS), width * m * BINS
            hist = [np.bincount(at.ravel(), np.repeat(v, m), size).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            G, H, C = (v[:, :, -1:] for v in hist)
            left = [v[:, :, :-1] for v in hist]
            gain = left[0] ** 2 / (left[1] + LAMBDA) + (G - left[0]) ** 2 / (H - left[1] + LAMBDA) - G**2 / (H + LAMBDA)
            gain = np.where((left[2] >= LEAST_ROWS) & (C - left[2] >= LEAST_ROWS), gain, -1.0).reshape(width, -1)
            best = gain.argmax(1)
            f, b = best // (BINS - 1), best % (BINS - 1)
            for k in range(width):
                if gain[k, best[k]] > 1e-9 and b[k] < len(cuts[f[k]]):
                    feature[first + k], threshold[first + k] = f[k], cuts[f[k]][b[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        where = node - inner
        leaf = -RATE * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + LAMBDA)
        margin += leaf[where]
        fs.append(feature)
        ts.append(threshold)
        ls.append(leaf)
    return Forest(np.array(fs), np.array(ts), np.array(ls), start)


# ------------------------------------------------------------------ on Spark


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols, texts in pieces(batches, ["y"], "text"):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([cols["y"].cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fit on at most ``rows`` labelled documents that are not held out."""
    usable = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["quality"].cast("double").alias("y")).filter("_id is not null and y is not null")
    usable = usable.filter(id_crc(F.col("_id")) % 3 != 1).groupBy("_id").agg(F.avg("y").alias("y"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # so many rows of 16 bytes are broadcast
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text"))
    got = d.join(F.broadcast(sample), d["doc_id"] == sample["_id"]).select("text", "y").mapInArrow(_stats, "y double, x array<double>")
    table = got.toArrow()
    if not table.num_rows:
        return fit(np.zeros((0, len(STATS))), np.zeros(0))
    x = np.stack(table.column("x").to_numpy())
    y = table.column("y").to_numpy()
    order = np.lexsort((y, *x.T))  # the same trees whatever order the rows came in
    return fit(x[order], (y[order] >= 0.5).astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(forest)  # TREES * 2**DEPTH entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, texts in pieces(batches, ["doc_id", "held_out"], "text"):
            s = model.value.score(statistics(texts))
            yield pa.RecordBatch.from_arrays([cols["doc_id"], cols["held_out"], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (id_crc(docs["doc_id"]) % 3 == 1).alias("held_out"), text_col(docs).alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
