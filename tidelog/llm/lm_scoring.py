"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training rows are quantised on a
logarithmic scale (steps of the square root of two). An n-gram of level q is
put into one Bloom filter under the keys (n-gram, 1) ... (n-gram, q); a count is
read back by probing level after level until one is missing. Errors are
one-sided: a count may be read too high.

Smoothing: P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU), where P(w) is the
additive estimate, and every c comes from the filter.

The filter grows with the input. It is dealt by hash into buckets, whose number
follows the number of tokens (BUCKET_TOKENS), and a bucket's part has as many
segments as its insertions need at BITS_EACH bits each, a key of level q being q
insertions. No n-gram is left out, and no part of the filter is broadcast.

The tokens of the corpus are written once as chunks: a chunk holds its distinct
words and, for its documents, indices into them. The distinct words and word
pairs of all chunks meet in buckets with their training counts; a bucket sums
the counts, builds its part of the filter and answers every chunk that asked,
with exact counts of words for the base score and with what the filter reads
for the model. So a frequent word or pair costs one entry a chunk, never one a
document.

Words are known by 64-bit hashes. Null text: empty, one token (the end). A null
doc_id is kept; its crc32 is that of the empty text, so it is held out. Repeated
rows are counted and scored one by one. Empty tables give empty tables. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import M1, Joined, id_crc, mix, pieces, release, shared_table, tasks_for, text_col

END = np.uint64(0x1D0C5E17A9B3F251)
START = np.uint64(0x7A3E5D9160C8B24F)
CHUNK_TOKENS = 1_000_000
SEGMENT_BITS = 23
SEGMENTS = 64  # of a filter that stands alone
FILTER_BYTES = SEGMENTS << (SEGMENT_BITS - 3)
#: Tokens of the corpus a bucket, and the least number of buckets.
BUCKET_TOKENS = 1 << 21
LEAST_BUCKETS = 256
HASHES = 4
BITS_EACH = 8
MAX_LEVEL = 80
MU = 100.0
ALPHA = 0.1


# ------------------------------------------------------------------ the filter


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, two more for each doubling."""
    return (1 + np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9)).astype(np.int64)


def value_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    low = np.ceil(2.0 ** ((levels - 1) / 2) - 1e-9)
    high = np.maximum(low, np.ceil(2.0 ** (levels / 2) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _spots(keys: np.ndarray, level: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions within a key's segment, one array for each hash."""
    h = mix(keys ^ (np.asarray(level).astype(np.uint64) * M1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield (h + np.uint64(k) * step) & np.uint64((1 << SEGMENT_BITS) - 1)


def segment_of(keys: np.ndarray, segments: int = SEGMENTS, skip: int = 0) -> np.ndarray:
    """A key's segment, from the 32 bits after its first ``skip``."""
    return (((keys << np.uint64(skip)) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def insert(bits: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> None:
    """Into one segment (a bool array), each key at the levels 1 to its own."""
    at = 1
    while len(keys):
        for spot in _spots(keys, at):
            bits[spot] = True
        on = levels > at
        keys, levels, at = keys[on], levels[on], at + 1


def segments_for(levels: np.ndarray) -> int:
    """Segments that hold keys of these levels at BITS_EACH bits an insertion."""
    return max(1, -(-int(levels.sum()) * BITS_EACH // (1 << SEGMENT_BITS)))


class LogBloom:
    """Packed bits of all segments; ``skip`` leading bits are the same in all keys."""

    def __init__(self, packed: np.ndarray, skip: int = 0):
        self.packed, self.skip = packed, skip
        self.segments = len(packed) >> (SEGMENT_BITS - 3)

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray, skip: int = 0) -> LogBloom:
        """A filter of the size that the keys need."""
        n = segments_for(levels)
        seg = segment_of(keys, n, skip)
        packed = np.empty((n, 1 << (SEGMENT_BITS - 3)), np.uint8)
        for s in range(n):
            one = np.zeros(1 << SEGMENT_BITS, bool)
            insert(one, keys[seg == s], levels[seg == s])
            packed[s] = np.packbits(one)
        return cls(packed.ravel(), skip)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        live, base, at = np.arange(len(keys)), segment_of(keys, self.segments, self.skip) << np.uint64(SEGMENT_BITS), 1
        while len(live) and at <= MAX_LEVEL:
            hit = np.ones(len(live), bool)
            for spot in _spots(keys[live], at):
                p = base[live] + spot
                hit &= (self.packed[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1 == 1
            live = live[hit]
            out[live] = at
            at += 1
        return out


# ------------------------------------------------------------------ the chunks

_CHUNK = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("flags", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())])
CHUNK = "chunk long, n long, ids binary, flags binary, sizes binary, tokens binary, words binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n, held = TaskContext.get().partitionId(), 0, []

    def flush() -> pa.RecordBatch:
        nonlocal n, held
        ids, flags, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        words, local = np.unique(hashes, return_inverse=True)
        row = [[(task << 32) | n], [len(hashes)], *([x.tobytes()] for x in (ids, flags, sizes.astype(np.int32), local.astype(np.int32), words))]
        held, n = [], n + 1
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _CHUNK, strict=True)], schema=_CHUNK)

    for cols, texts in pieces(batches, ["doc_id", "train"], "text"):
        _, _, h, counts = Joined(texts, lowered=True).words()
        ends = np.cumsum(counts)
        h = np.insert(h, ends, END)  # one end after each document's words
        ids = cols["doc_id"]
        null = ids.is_null().to_numpy(zero_copy_only=False)
        train = cols["train"].to_numpy(zero_copy_only=False)
        held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), train.astype(np.uint8) | (null.astype(np.uint8) << 1), counts + 1, h))
        if sum(len(x[3]) for x in held) >= CHUNK_TOKENS:
            yield flush()
    if held:
        yield flush()


class Chunk:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        flags = np.frombuffer(row["flags"], np.uint8)
        self.train, self.null = (flags & 1) == 1, (flags & 2) == 2
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.tokens = np.frombuffer(row["tokens"], np.int32)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def pairs(self) -> np.ndarray:
        """Hash of (word before, word) for each token; the first has START before it."""
        h = self.words[self.tokens]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.first] = START
        return pair_hash(before, h)


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before + M1) + word)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(counts[order], at)


# ------------------------------------------------ counts and filter, by bucket

ASK = "bucket int, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWER = "bucket int, chunk long, counts binary, word_levels binary, pair_levels binary, n long, v long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, t in enumerate(kinds)], names=list(names))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane after byte plane: the high ones are zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def buckets_for(tokens: int) -> int:
    """A power of two that follows the number of tokens."""
    return max(LEAST_BUCKETS, 1 << max(0, tokens // BUCKET_TOKENS).bit_length())


def _ask(bits: int):
    """Each chunk's distinct words and pairs with its own training counts, by the first ``bits`` of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = Chunk(row)
            pairs, local = np.unique(c.pairs(), return_inverse=True)
            train = np.repeat(c.train, c.sizes)
            asked = []
            for keys, at in ((c.words, c.tokens), (pairs, local)):
                cut = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                asked.append((keys, np.bincount(at[train], minlength=len(keys)).astype(np.int32), cut.tolist()))
            out = []
            for k in range(1 << bits):
                if any(cut[k] < cut[k + 1] for _, _, cut in asked):
                    out.append((k, row["chunk"], *(x for keys, own, cut in asked for x in (packed(keys[cut[k] : cut[k + 1]]), own[cut[k] : cut[k + 1]].tobytes()))))
            yield _batch(out, ASK)

    return run


def _total(rows: list[dict], name: str) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([r[name + "s"] for r in rows])
    return summed(keys, np.concatenate([np.frombuffer(r[name + "_counts"], np.int32) for r in rows]).astype(np.int64))


def _answer(bits: int):
    """Sum the counts of a bucket, build its filter, answer every chunk that asked."""

    def told(rows: list[dict]) -> pa.RecordBatch:
        words, counts = _total(rows, "word")
        pairs, pair_counts = _total(rows, "pair")
        every = np.concatenate([counts, pair_counts])
        known = every > 0
        bloom = LogBloom.of(np.concatenate([words, pairs])[known], level_of(every[known]), bits)
        word_levels, pair_levels = (bloom.levels(x).astype(np.uint8) for x in (words, pairs))
        out, bucket = [], rows[0]["bucket"]
        for r in rows:
            w, p = (np.searchsorted(all_, r[name]) for all_, name in ((words, "words"), (pairs, "pairs")))
            out.append((bucket, r["chunk"], counts[w].tobytes(), word_levels[w].tobytes(), pair_levels[p].tobytes(), None, None))
        out.append((bucket, None, None, None, None, int(counts.sum()), int((counts > 0).sum())))
        return _batch(out, ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):  # sorted by bucket
            if held and row["bucket"] != held[0]["bucket"]:
                yield told(held)
                held = []
            held.append(row | {x: unpacked(row[x]) for x in ("words", "pairs")})
        if held:
            yield told(held)

    return run


# -------------------------------------------------------------------- scoring

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(total: int, distinct: int, starts: int):
    def per_chunk(row: dict, counts: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray) -> pa.RecordBatch:
        c = Chunk(row)
        base = np.log10((counts + ALPHA) / (total + ALPHA * (distinct + 1)))
        seen = value_of(word_levels)  # the model's own counts
        uni = (seen + ALPHA) / (total + ALPHA * (distinct + 1))
        tok = c.tokens
        ctx = np.empty(len(tok))
        ctx[1:] = seen[tok[:-1]]
        ctx[c.first] = starts
        _, pair = np.unique(c.pairs(), return_inverse=True)
        both = np.minimum(value_of(pair_levels)[pair], ctx)
        model_log = np.log10((both + MU * uni[tok]) / (ctx + MU))
        parts = (c.ids, ~c.train, c.sizes, np.add.reduceat((counts > 0).astype(np.int64)[tok], c.first), np.full(len(c.ids), total), np.add.reduceat(base[tok], c.first), np.add.reduceat(model_log, c.first))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        arrays = [pa.array(x, t, mask=c.null if k == 0 else None) for k, (x, t) in enumerate(zip(parts, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, told = None, []
        for row in _rows(batches):  # a chunk's answers come before the chunk, in the order of buckets, which is that of hashes
            if row["chunk"] != chunk:
                chunk, told = row["chunk"], []
            if row["bucket"] is not None:
                told.append((row["counts"], row["word_levels"], row["pair_levels"]))
                continue
            counts, word_levels, pair_levels = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*told, strict=True), (np.int64, np.uint8, np.uint8), strict=True))
            yield per_chunk(row, counts, word_levels.astype(np.int64), pair_levels.astype(np.int64))

    return run


def score_documents(docs: DataFrame, train=None) -> DataFrame:
    """Score ``doc_id, text`` rows; learn from rows where ``train`` (a Column) is true."""
    spark = docs.sparkSession
    if train is None:
        train = id_crc(docs["doc_id"]) % 10 != 0
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text"), train.alias("train"))
    chunks = shared_table(d.mapInArrow(_chunks, CHUNK), "lm-chunks")
    parts = tasks_for(spark)
    bits = buckets_for(chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).bit_length() - 1
    asked = chunks.mapInArrow(_ask(bits), ASK).repartition(parts, "bucket").sortWithinPartitions("bucket")
    answers = shared_table(asked.mapInArrow(_answer(bits), ANSWER), "lm-answers")
    del asked
    release(spark)
    stats = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    starts = d.filter("train").count()
    release(spark)  # the last job before a call is still referred to
    told = answers.filter("chunk is not null").drop("n", "v")
    both = chunks.drop("n").unionByName(told, allowMissingColumns=True)
    laid = both.repartition(parts, "chunk").sortWithinPartitions("chunk", F.asc_nulls_last("bucket"))
    return laid.mapInArrow(_score(int(stats[0]), int(stats[1]), starts), SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
