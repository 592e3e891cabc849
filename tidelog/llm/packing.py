"""Packing along a space-filling curve.

Each document's tokens are counted into a hashed vector, which a fixed random
matrix projects to three dimensions; the Hilbert key of that point is the
document's place on a curve. Documents are range-sorted by key, and each range
lays its documents end to end and cuts the stream every 2048 tokens, so
neighbours on the curve, which use like words, share sequences.

Padding: only the end of a range leaves less than a whole sequence. It is cut
into sequences whose lengths are powers of two, which need no padding.

Tokens: the tokenizer sees each distinct piece of text once. Pieces end at ASCII
white space and between a letter or digit and the punctuation that ends a word,
where the tokenizer itself always breaks, so joining the pieces' ids gives the ids
of the text. Words of ASCII and Latin-1 letters are set to lower case before, as
the tokenizer does; others (combining marks, special tokens) are left as they are.
A piece's ids and its part of the projection are kept together, so a document's
point is a sum over pieces.

Documents are tokenized once and written, 2 bytes a token, because the range
bounds need a pass of their own over the keys. Equal keys (a large group of
copies) are told apart by doc_id and by row, so no group has to meet in one
range. Null text: empty, one id (the end id). Null doc_id: kept. Repeated rows
are packed one by one. Empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import Joined, Rolling, mix, pieces, shared_table, tasks_for, text_col, word_bounds

LENGTH = 2048
END_ID = 1
DIMS = 3
ORDER = 20  # bits a dimension
SEGMENT = 4096  # tokens of a row at most
HASHED = 4096


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LATIN = 0xC3  # first byte of the letters U+00C0 to U+00FF (and of two signs, next line)
_SIGNS = (0x97, 0xB7)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD_LATIN = np.arange(256, dtype=np.uint8)
_FOLD_LATIN[0x80:0x9F] += 32
_FOLD_LATIN[0x97] = 0x97
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_MARK = np.zeros(256, bool)  # punctuation that may be cut off; not ' (contractions) and not < (special tokens)
_MARK[[c for c in range(33, 127) if not _ALNUM[c] and c not in b"'<"]] = True
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def text_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with plain words in lower case, starts, ends) of the pieces of a text."""
    s, e = word_bounds(data)
    if not len(s):
        return data, s, e
    latin = np.zeros(len(data), bool)
    latin[1:] = data[:-1] == _LATIN
    folded = np.where(latin, _FOLD_LATIN[data], _FOLD[data])
    odd = (data >= 0x80) & (data != _LATIN) & ~latin | (data == ord("<"))
    plain = np.ones(len(s), bool)
    if odd.any():
        plain = np.add.reduceat(odd, s) == 0
        inside = np.zeros(len(data) + 1, np.int8)
        inside[s[~plain]] += 1
        inside[e[~plain]] -= 1
        folded = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, data, folded)
    cut = np.maximum(np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data))))[e - 1] + 1, s)
    before = np.maximum(cut - 1, 0)
    letter = _ALNUM[data[before]] | latin[before] & ~np.isin(data[before], _SIGNS)
    at = np.flatnonzero(plain & (cut > s) & (cut < e) & letter)
    return folded, np.insert(s, at + 1, cut[at]), np.insert(e, at, cut[at])


class WordTokenizer:
    """Ids of whole texts, by way of each distinct piece once.

    Known pieces are numbered; their hashes lie in a large sorted list and a small
    one of the latest, which is merged in now and then. Number 0 is the end of a
    text. Beyond CACHE pieces it starts anew.
    """

    CACHE = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # a piece of lower-case letters is one unit of the tokenizer as it stands: nothing to normalise, nothing to split
        spec = json.loads(self.tok.to_str())
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.matrix = projection()
        self._forget()

    def _forget(self) -> None:
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2  # hashes in order, and numbers
        self.ids, self.size = np.full(1, END_ID, np.uint16), np.ones(1, np.int64)
        self.first, self.point = np.zeros(1, np.int64), self.matrix[_slot(self.ids)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for have, number in self.known:
            if len(have):
                k = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[k] == keys
                out[hit] = number[k[hit]]
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Take up pieces by their hashes, in order."""
        got: list[list[int]] = [[]] * len(words)
        plain = [_PLAIN.fullmatch(w) is not None for w in words]
        for tok, own in ((self.bare, True), (self.tok, False)):
            at = [k for k, p in enumerate(plain) if p is own]
            for a in range(0, len(at), 20_000):
                part = at[a : a + 20_000]
                for k, x in zip(part, tok.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                    got[k] = x.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint16, int(size.sum()))
        total = np.concatenate([np.zeros((1, DIMS)), np.cumsum(self.matrix[_slot(ids)], axis=0)])
        ends = np.cumsum(size)
        number = len(self.size) + np.arange(len(words))
        self.first = np.concatenate([self.first, len(self.ids) + ends - size])
        self.point = np.concatenate([self.point, total[ends] - total[ends - size]])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        old, late = self.known
        late = _merged(late, (keys, number))
        self.known = [_merged(old, late), (keys[:0], number[:0])] if len(late[0]) > 50_000 + len(old[0]) // 4 else [old, late]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of all texts, END_ID after each; the number for each text, and its sum of projected ids."""
        j = Joined(texts)
        data, s, e = text_pieces(j.data)
        h = Rolling(data).spans(s, e)
        counts = np.diff(np.searchsorted(s, np.append(j.starts, len(data) + 1)))
        if len(self.size) > self.CACHE:
            self._forget()
        keys, at, local = np.unique(h, return_index=True, return_inverse=True)
        number = self._find(keys)
        if len(new := np.flatnonzero(number == 0)):
            raw, first = data.tobytes(), at[new]
            number[new] = len(self.size) + np.arange(len(new))
            self._learn(keys[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        ends = np.cumsum(counts)
        which = np.insert(number[local], ends, 0)  # the end of each text
        n = self.size[which]
        total = np.cumsum(n)
        where = np.repeat((self.first[which] - (total - n)).astype(np.int32), n)
        where += np.arange(len(where), dtype=np.int32)
        stops = ends + np.arange(len(texts))  # place of each text's end in ``which``
        begins = np.concatenate([[0], stops[:-1] + 1])
        return self.ids[where], np.diff(np.concatenate([[0], total[stops]])), np.add.reduceat(self.point[which], begins, axis=0)


def _merged(a: tuple, b: tuple) -> tuple:
    keys, number = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], number[order]


def _slot(ids: np.ndarray) -> np.ndarray:
    """Place of an id in the hashed vector."""
    return (ids.astype(np.int64) * 40_503 + 7) % HASHED


def projection() -> np.ndarray:
    """HASHED x DIMS matrix of fixed pseudo-random signs."""
    bits = mix(np.arange(HASHED * DIMS, dtype=np.uint64) + np.uint64(20_011))
    return np.where(bits >> np.uint64(63), 1.0, -1.0).reshape(HASHED, DIMS)


def hilbert_keys(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Hilbert index of integer points (rows) with ``order`` bits a dimension.

    Works on all rows at once: bit planes from high to low are turned into the
    frame of the sub-cube they lie in, then Gray-decoded and interleaved.
    """
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    plane = 1 << (order - 1)
    while plane > 1:
        low = plane - 1
        for d in range(dims):
            high = (x[:, d] & plane) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap
        plane >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    plane = 1 << (order - 1)
    while plane > 1:
        flip ^= np.where(x[:, dims - 1] & plane, plane - 1, 0)
        plane >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(order - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def curve_keys(points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places on the curve, from sums of projected ids and numbers of ids."""
    mean = points / np.maximum(counts, 1)[:, None]
    grid = np.floor((np.tanh(2.5 * mean) + 1) / 2 * (1 << ORDER)).astype(np.int64)
    return hilbert_keys(np.clip(grid, 0, (1 << ORDER) - 1))


TOKENS = "doc_id long, row long, curve long, start long, total long, ids binary"


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents' ids in segments, each with its document's place on the curve.

    Range bounds are drawn by rows, so rows of bounded size make even ranges.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, row = WordTokenizer(path), TaskContext.get().partitionId() << 36
        for cols, texts in pieces(batches, ["doc_id"], "text", 1 << 21):
            ids, counts, points = tok.encode(texts)
            n = -(-counts // SEGMENT)  # segments of each text
            of = np.repeat(np.arange(len(texts)), n)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
            size = np.minimum(counts[of] - start, SEGMENT)
            offsets = np.concatenate([[0], np.cumsum(size * 2)]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
            parts = [cols["doc_id"].take(pa.array(of)), pa.array(row + of), pa.array(curve_keys(points, counts)[of]), pa.array(start), pa.array(counts[of]), blob]
            yield pa.RecordBatch.from_arrays(parts, names=[x.split()[0] for x in TOKENS.split(", ")])
            row += len(texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text")).mapInArrow(run, TOKENS)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"


def _lay_out(with_ids: bool):
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def rows(held: list, sequence: int, cut: list[int]) -> Iterator[tuple]:
        """Pieces of the held spans, cut into sequences of the given lengths."""
        k, used = 0, 0
        for doc, curve, total, start, ids in held:
            while len(ids):
                take = min(len(ids), cut[k] - used)
                part = ids[:take]
                out = (doc, start, take, zlib.crc32(part.astype("<u4")), total, sequence + k, used, curve)
                yield (*out, part.astype(np.int32).tolist()) if with_ids else out
                ids, start, used = ids[take:], start + take, used + take
                if used == cut[k]:
                    k, used = k + 1, 0

    def batch_of(out: list) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held, size, out = TaskContext.get().partitionId() << 36, [], 0, []
        for batch in batches:
            for doc, curve, start, total, blob in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), batch.column(5), strict=True):
                ids = np.frombuffer(blob.as_buffer(), np.uint16)
                held.append((doc, curve, total, start, ids))
                size += len(ids)
                if whole := size // LENGTH:
                    doc, curve, total, start, ids = held.pop()
                    rest = size - whole * LENGTH
                    held.append((doc, curve, total, start, ids[: len(ids) - rest]))
                    out += rows(held, sequence, [LENGTH] * whole)
                    held = [(doc, curve, total, start + len(ids) - rest, ids[len(ids) - rest :].copy())] if rest else []
                    sequence, size = sequence + whole, rest
                else:
                    held[-1] = (doc, curve, total, start, ids.copy())
                if len(out) >= 20_000 or with_ids and len(out) >= 500:
                    yield batch_of(out)
                    out = []
        cut = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
        out += rows(held, sequence, cut)
        if out:
            yield batch_of(out)

    return run


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, each with its sequence and place; ``ids`` if asked."""
    tokens = shared_table(tokenized(docs, path), "tokens")
    laid = tokens.repartitionByRange(tasks_for(docs.sparkSession), "curve", "doc_id", "row", "start").sortWithinPartitions("curve", "doc_id", "row", "start")
    return laid.mapInArrow(_lay_out(with_ids), PIECES + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
