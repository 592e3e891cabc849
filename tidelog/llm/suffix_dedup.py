r"""Removal of repeated passages by a distributed difference-cover suffix sort.

Every byte covered by a string of LENGTH bytes that starts anywhere else too is
removed. That needs the order of suffixes only to depth LENGTH: whether a suffix
shares its first LENGTH bytes with a neighbour. (LENGTH, V and the cover are
those of a :class:`Unit`: 400, 183 and 14 residues for bytes.)

1. Sample. Positions whose remainder modulo V lies in a difference cover are
   sampled (the perfect cover of 14 residues modulo 183, in the place of the two
   residues modulo 3). For any two positions there is one shift below V that
   makes both samples, so two equal strings of LENGTH bytes hold an aligned pair
   of samples, each with LENGTH - V + 1 equal bytes after it. These bytes are a
   sample's tuple; its name is their hash, and names meet in buckets, sorted.
   Samples with a name of their own cannot lie in a repeated string; the others
   leave candidate runs of starts.
2. Recurse on names. Among the tuples inside a candidate string the one with the
   least name is its anchor: equal strings have equal anchors at equal shifts.
   The consecutive starts of one anchor, with all bytes they reach, are a
   context. Contexts meet by name: one that occurs twice is repeated whole.
3. Merge the rest. A context that occurs once, but whose anchor's name has other
   contexts, may share some starts with them. Their suffixes are merged singly:
   hashes of LENGTH bytes meet, sorted, and equal neighbours are repeated.

Everything that meets is sent in packed blobs, what repeats within a task is
resolved there, and one entry a task goes on, so a passage in a third of all
documents costs its bucket one entry a task. Texts are known by two 64-bit
hashes, names are 64-bit hashes, so copies of a text share their runs and
documents without or with equal doc_ids are no special case.

The same steps find passages of over 50 words: symbols are then the hashes of
words (``[^\x20\x09-\x0D]+``, whatever white space lies between) instead of
bytes, a string has 51 of them and the cover is that of 4 residues modulo 13.
What goes there are the bytes from the first word of a run to its last.

Null text: empty; nothing removed. Texts below a unit's length: nothing removed.
Copies of longer texts are removed whole, all of them. Repeated rows are copies.
Empty tables give empty tables; extra columns are ignored by the query and kept
by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import M1, Rolling, drop_table, mix, release, shared_table, tasks_for, text_col, to_buckets, word_bounds, word_hashes

FLUSH = 1_500_000
EMPTY = np.zeros(0, np.int64)


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """v = q*q + q + 1 and q + 1 residues whose differences are all residues mod v.

    Powers of a generator of GF(q^3) that lie in a plane over GF(q), q prime.
    """
    v = q * q + q + 1
    for c0 in range(1, q):
        for c1 in range(q):
            for c2 in range(q):
                x, found = (1, 0, 0), []
                for k in range(v):
                    if x[2] == 0:
                        found.append(k)
                    x = (x[2] * c0 % q, (x[0] + x[2] * c1) % q, (x[1] + x[2] * c2) % q)
                if len(found) == q + 1 and len({(a - b) % v for a in found for b in found}) == v:
                    return v, np.array(found, np.int64)
    raise ValueError(f"no cover for {q}")


class Unit(NamedTuple):
    """What strings are made of, and how long one is that must not repeat."""

    length: int
    v: int
    cover: np.ndarray
    least_bytes: int  # no text of fewer bytes holds a string
    words: bool

    @property
    def tuple(self) -> int:
        return self.length - self.v + 1

    def roll(self, data: np.ndarray) -> Rolling:
        """Hashes of spans of the symbols of a text."""
        return Rolling(word_hashes(data)[2] if self.words else data)

    def cut(self, data: np.ndarray, spans: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Byte intervals that repeated starts remove from a text."""
        if not spans:
            return EMPTY, EMPTY
        s, e = unpack_intervals(spans)
        e = e - 1 + self.length
        if self.words:
            first, end = word_bounds(data)
            s, e = first[s], end[e - 1]
        return union(s, e)


BYTES = Unit(400, *difference_cover(13), 400, False)
WORDS = Unit(51, *difference_cover(3), 101, True)


# ------------------------------------------------------------------ intervals


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals [start, end) of the union, in order; touching ones join."""
    if not len(starts):
        return EMPTY, EMPTY
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([new[1:], [True]])]


def pack_intervals(s: np.ndarray, e: np.ndarray) -> bytes:
    return np.stack([s, e]).astype(np.int32).tobytes()


def unpack_intervals(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, np.int32).astype(np.int64)
    return x[: len(x) // 2], x[len(x) // 2 :]


# ------------------------------------------------------------- blobs that meet
# Entries are columns of equal length; the first is the key by which they meet.
# kind 1 entries stand for a key already known to occur twice.


class Table:
    """Columns of entries with their types, to and from one binary blob."""

    def __init__(self, *kinds: str):
        self.kinds = [np.dtype(k) for k in kinds]
        self.width = sum(k.itemsize for k in self.kinds)

    def pack(self, cols: list[np.ndarray]) -> bytes:
        return b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(cols, self.kinds, strict=True))

    def unpack(self, raw: bytes) -> list[np.ndarray]:
        n, at, out = len(raw) // self.width, 0, []
        for k in self.kinds:
            out.append(np.frombuffer(raw, k, n, at))
            at += n * k.itemsize
        return out

    def join(self, parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        if not parts:
            return [np.zeros(0, k) for k in self.kinds]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]


SENT = "bucket int, data binary"


def _sent(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"])


def _known() -> int:
    """A bucket below 0, one a task: what it holds needs to meet nothing and is spread over all tasks."""
    return -1 - TaskContext.get().partitionId()


def _to_buckets(table: Table, cols: list[np.ndarray], buckets: int) -> list[tuple[int, bytes]]:
    order, cut = to_buckets(cols[0] ^ M1, buckets)
    return [(k, table.pack([c[order[a:b]] for c in cols])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order, whether an entry (sorted) is the first of its key, key number of each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    return order, head, np.cumsum(head) - 1


def _split_repeats(cols: list[np.ndarray], kind_at: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(entries to send on, one a key; entries known to be repeated) of one task.

    A key of several entries, or with a kind 1 entry, is repeated: its entries
    are given out here and what is sent has kind 1. Entries of kind 1 are never
    given out, they stand for others.
    """
    order, head, group = _groups(cols[0])
    cols = [c[order] for c in cols]
    n = group[-1] + 1 if len(group) else 0
    many = (np.bincount(group, minlength=n) > 1) | (np.bincount(group, cols[kind_at], minlength=n) > 0)
    out = [c[many[group] & (cols[kind_at] == 0)] for c in cols]
    send = [c[head].copy() for c in cols]
    send[kind_at] = many.astype(send[kind_at].dtype)
    return send, out


# ------------------------------------------------------- 1. the difference cover

NAMES = Table("u8", "i8", "i4", "u1")  # name, text, position, kind


def sample(n: int, unit: Unit) -> np.ndarray:
    """Sampled positions of n symbols with a whole tuple after them."""
    last = n - unit.tuple
    blocks = np.arange(0, max(last, 0) + unit.v, unit.v)
    at = (blocks[:, None] + unit.cover[None, :]).ravel()
    return at[at <= last]


def _send_names(buckets: int, unit: Unit):
    def flush(held: list) -> pa.RecordBatch:
        send, out = _split_repeats(NAMES.join(held), 3)
        rows = _to_buckets(NAMES, send, buckets)
        rows.append((_known(), NAMES.pack(out)))
        return _sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                roll = unit.roll(np.frombuffer(text.as_buffer(), np.uint8))
                if roll.n < unit.length:
                    continue
                at = sample(roll.n, unit)
                held.append([roll.spans(at, at + unit.tuple), np.full(len(at), th, np.int64), at.astype(np.int32), np.zeros(len(at), np.uint8)])
                size += len(at)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _meet_names(buckets: int, v: int):
    """Runs of candidate starts around repeated samples, on their way to their texts."""

    def send(th: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        pos = pos.astype(np.int64)
        return _send_spans(buckets, th, np.zeros(len(th), np.int64), np.maximum(pos - v + 1, 0), pos + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cols = NAMES.unpack(raw)
                if bucket < 0:
                    yield from send(cols[1], cols[2])
                else:
                    held.append(cols)
        _, out = _split_repeats(NAMES.join(held), 3)
        yield from send(out[1], out[2])

    return run


# ------------------------------------------------------- 2. anchors and contexts

CONTEXTS = Table("u8", "u8", "i8", "i8", "i4", "i4", "u1")  # context, name, th, th2, first and last start, kind
FOUND = "name long, th long, th2 long, a int, b int, kind int"  # kind 0: once, 1: stands for several, 2: repeated starts


def anchors(names: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` names, the place of its least; the first of equals."""
    n = len(names) - width + 1
    low = np.uint64((1 << 24) - 1)
    keys = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)


STRETCH = 1 << 22  # starts looked at together; a longer run overlaps by nothing, as anchors depend on a start alone


def contexts(roll: Rolling, s: np.ndarray, e: np.ndarray, unit: Unit) -> list[np.ndarray]:
    """context, name, first start, last start for all anchors of the runs [s, e)."""
    out = []
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        for x in range(a, b, STRETCH):
            y = min(b, x + STRETCH)
            at = np.arange(x, y - 1 + unit.v)
            names = roll.spans(at, at + unit.tuple)
            who = anchors(names, unit.v)
            cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            first, last = x + cut, x + np.concatenate([cut[1:], [y - x]]) - 1
            key = mix(roll.spans(first, last + unit.length) ^ (who[cut] - cut).astype(np.uint64))
            out.append([key, names[who[cut]], first, last])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else []


def _found(name, th, th2, a, b, kind: int) -> pa.RecordBatch:
    cols = [np.asarray(name).view(np.int64), th, th2, a, b, np.full(len(th), kind, np.int32)]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["name", "th", "th2", "a", "b", "kind"])


def _send_contexts(buckets: int, unit: Unit):
    def flush(held: list) -> pa.RecordBatch:
        send, out = _split_repeats(CONTEXTS.join(held), 6)
        rows = _to_buckets(CONTEXTS, send, buckets)
        rows.append((_known(), CONTEXTS.pack(out)))
        return _sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for th, th2, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                roll = unit.roll(np.frombuffer(text.as_buffer(), np.uint8))
                s, e = unpack_intervals(runs)
                e = np.minimum(e, roll.n - unit.length + 1)
                got = contexts(roll, s[e > s], e[e > s], unit)
                if got:
                    key, name, a, b = got
                    n = len(key)
                    held.append([key, name, np.full(n, th, np.int64), np.full(n, th2, np.int64), a.astype(np.int32), b.astype(np.int32), np.zeros(n, np.uint8)])
                    size += n
                if size >= FLUSH // 2:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _meet_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cols = CONTEXTS.unpack(raw)
            if bucket < 0:
                yield _found(*cols[1:6], 2)
            else:
                held.append(cols)
    if not held:
        return
    cols = CONTEXTS.join(held)
    send, out = _split_repeats(cols, 6)
    yield _found(*out[1:6], 2)
    for kind in (0, 1):
        yield _found(*(c[send[6] == kind] for c in send[1:6]), kind)


# -------------------------------------------------------- 3. the rest, singly

STARTS = Table("u8", "i8", "i8", "i4", "u1")  # hash of LENGTH symbols, th, th2, start, kind
SPANS = "th long, th2 long, spans binary"


INTERVALS = Table("i8", "i8", "i4", "i4")  # th, th2, first repeated start and one past the last of a run
_APART = np.int64(1 << 32)  # texts as stretches of one line


def _by_text(th, th2, a, b) -> list[np.ndarray]:
    """Runs of starts [a, b) of all texts, joined within each text; in order of texts."""
    order = np.lexsort((th2, th))
    th, th2, a, b = th[order], th2[order], a[order].astype(np.int64), b[order].astype(np.int64)
    new = np.concatenate([[True], (th[1:] != th[:-1]) | (th2[1:] != th2[:-1])])
    text = np.cumsum(new) - 1
    s, e = union(text * _APART + a, text * _APART + b)
    of, first = s // _APART, np.flatnonzero(new)
    return [th[first][of], th2[first][of], s - of * _APART, e - of * _APART]


def _send_spans(buckets: int, th, th2, a, b) -> Iterator[pa.RecordBatch]:
    """Runs to the buckets of their texts, one blob a bucket however many texts there are."""
    if len(th):
        cols = _by_text(th, th2, a, b)
        order, cut = to_buckets(cols[0].view(np.uint64), buckets)
        yield _sent([(k, INTERVALS.pack([c[order[x:y]] for c in cols])) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x])


def _meet_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text with all its runs."""
    held = [INTERVALS.unpack(raw) for batch in batches for raw in batch.column(1).to_pylist()]
    if not held:
        return
    th, th2, s, e = _by_text(*INTERVALS.join(held))
    del held
    cut = np.flatnonzero(np.concatenate([[True], (th[1:] != th[:-1]) | (th2[1:] != th2[:-1]), [True]]))
    for k in range(0, len(cut) - 1, 4096):
        ends = cut[k : k + 4097]
        rows = [pack_intervals(s[x:y], e[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(th[ends[:-1]], pa.int64()), pa.array(th2[ends[:-1]], pa.int64()), pa.array(rows, pa.binary())], names=["th", "th2", "spans"])


def _send_starts(buckets: int, unit: Unit):
    def flush(held: list) -> pa.RecordBatch:
        send, out = _split_repeats(STARTS.join(held), 4)
        rows = _to_buckets(STARTS, send, buckets)
        rows.append((_known(), STARTS.pack(out)))
        return _sent(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for th, th2, text, open_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                roll = unit.roll(np.frombuffer(text.as_buffer(), np.uint8))
                a, b, kind = (np.array([x[k] for x in open_], np.int64) for k in ("a", "b", "kind"))
                n = b - a + 1
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                held.append([roll.spans(at, at + unit.length), np.full(len(at), th, np.int64), np.full(len(at), th2, np.int64), at.astype(np.int32), np.repeat(kind, n).astype(np.uint8)])
                size += len(at)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _meet_starts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cols = STARTS.unpack(raw)
                if bucket < 0:
                    yield from _send_spans(buckets, cols[1], cols[2], cols[3], cols[3] + 1)
                else:
                    held.append(cols)
        _, out = _split_repeats(STARTS.join(held), 4)
        yield from _send_spans(buckets, out[1], out[2], out[3], out[3] + 1)

    return run


def _spans_of_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            th, th2, a, b = (x.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield from _send_spans(buckets, th, th2, a, b + 1)

    return run


# ------------------------------------------------------------------ on Spark


def repeated_starts(texts: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(th, th2, spans): the starts of repeated strings in symbols, packed intervals a text.

    ``texts`` has th, th2 (hashes of the text) and data (its bytes), one row a document.
    """
    spark = texts.sparkSession
    parts = tasks_for(spark)
    long = texts.filter(F.octet_length("data") >= unit.least_bytes)
    names = long.select("th", "data").mapInArrow(_send_names(parts, unit), SENT).repartition(parts, "bucket")
    runs = names.mapInArrow(_meet_names(parts, unit.v), SENT).repartition(parts, "bucket").mapInArrow(_meet_spans, SPANS)
    runs = shared_table(runs.select(F.col("th").alias("_th"), F.col("spans").alias("runs")), "runs")
    release(spark)

    # texts meet what was found about them by shuffle at every size: what was found grows with the input
    near = long.join(runs.hint("merge"), long["th"] == runs["_th"]).select("th", "th2", "data", "runs")
    met = near.mapInArrow(_send_contexts(parts, unit), SENT).repartition(parts, "bucket").mapInArrow(_meet_contexts, FOUND)
    met = shared_table(met, "contexts")
    release(spark)

    single = met.filter("kind < 2")
    mixed = single.groupBy(F.col("name").alias("_name")).agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("low")).filter("n > 1 and low = 0").select("_name")
    mixed = shared_table(mixed, "mixed").hint("merge")  # a table, so that Spark can split the join on a name that very many have
    open_ = single.join(mixed, single["name"] == mixed["_name"]).groupBy(F.col("th").alias("_th"), F.col("th2").alias("_th2")).agg(F.collect_list(F.struct("a", "b", "kind")).alias("open"))
    open_ = shared_table(open_, "open")
    todo = long.join(open_.hint("merge"), (long["th"] == open_["_th"]) & (long["th2"] == open_["_th2"])).select("th", "th2", "data", "open")
    rest = shared_table(todo.mapInArrow(_send_starts(parts, unit), SENT).repartition(parts, "bucket").mapInArrow(_meet_starts(parts), SENT), "rest")
    release(spark)

    sure = met.filter("kind = 2").select("th", "th2", "a", "b").mapInArrow(_spans_of_rows(parts), SENT)
    spans = shared_table(sure.unionByName(rest).repartition(parts, "bucket").mapInArrow(_meet_spans, SPANS), "spans")
    release(spark)
    for t in (runs, met, mixed, open_, rest):
        drop_table(t)
    return spans


def kept_bytes(raw: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    if not len(s):
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))


def _hashed(docs: DataFrame, *columns) -> DataFrame:
    text = text_col(docs)
    return docs.select(*columns, F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2"), F.encode(text, "utf-8").alias("data"))


def _with_spans(docs: DataFrame, *columns, passages: bool) -> DataFrame:
    """The columns, data and the repeated starts in bytes (_spans) and, for passages, in words (_words)."""
    d = _hashed(docs, *columns)
    spans = repeated_starts(d.select("th", "th2", "data")).select(F.col("th").alias("_th"), F.col("th2").alias("_th2"), F.col("spans").alias("_spans"))
    if passages:
        words = repeated_starts(d.select("th", "th2", "data"), WORDS).select(F.col("th").alias("_th"), F.col("th2").alias("_th2"), F.col("spans").alias("_words"))
        spans = shared_table(spans.join(words, ["_th", "_th2"], "full"), "both")
        release(docs.sparkSession)
    else:
        spans = spans.withColumn("_words", F.lit(None).cast("binary"))
    return d.join(spans.hint("merge"), (d["th"] == spans["_th"]) & (d["th2"] == spans["_th2"]), "left")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, changed boolean, n_kept long, text string, n_left long, text_left string"


def _cut(data: np.ndarray, spans: bytes | None, words: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Byte intervals of both kinds of strings together."""
    (s, e), (s2, e2) = BYTES.cut(data, spans), WORDS.cut(data, words)
    return union(np.concatenate([s, s2]), np.concatenate([e, e2]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contract's columns, then whether a byte went, the bytes kept and the text they make (less a character cut in two).

    Last the bytes and the text that stay once passages of over 50 words go as well.
    """
    for batch in batches:
        rows = []
        for data, spans, words in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = data.as_buffer().to_pybytes()
            at = np.frombuffer(raw, np.uint8)
            s, e = BYTES.cut(at, spans)
            kept = kept_bytes(raw, s, e)
            left = kept_bytes(raw, *_cut(at, spans, words)) if words else kept
            rows.append((len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), len(s) > 0, len(kept), kept.decode("utf-8", "ignore"), len(left), left.decode("utf-8", "ignore")))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _with_spans(docs, docs["doc_id"].cast("long").alias("doc_id"), passages=True).select("doc_id", "data", "_spans", "_words").mapInArrow(_digest, DIGEST)


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and ``n_chars`` set anew.

    With ``passages`` those of over 50 words go too, whatever bytes they have.
    A cut may fall inside a character; the broken rest of it goes too. Rows whose
    whole text goes are dropped; rows that were empty before stay.
    """
    names = docs.columns
    held = F.struct(*[docs[c] for c in names]).alias("_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for data, spans, words in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = data.as_buffer().to_pybytes()
                s, e = _cut(np.frombuffer(raw, np.uint8), spans, words)
                out.append(kept_bytes(raw, s, e).decode("utf-8", "ignore") if len(s) else None)
                keep.append(not len(s) or bool(out[-1].strip()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "_new"]).filter(pa.array(keep, pa.bool_()))

    d = _with_spans(docs, held, passages=passages).select("_row", "data", "_spans", "_words")
    cut = d.mapInArrow(run, f"_row {d.schema['_row'].dataType.simpleString()}, _new string")
    cols = []
    for c in names:
        old = F.col("_row").getField(c)
        new = {"text": F.coalesce("_new", old), "n_chars": F.when(F.col("_new").isNotNull(), F.char_length("_new").cast(docs.schema[c].dataType)).otherwise(old)}.get(c, old)
        cols.append(new.alias(c))
    return cut.select(*cols)
