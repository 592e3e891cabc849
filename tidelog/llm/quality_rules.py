"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Repetitive
text compresses far better, random or encoded text far worse than prose, so
each length class has a band of allowed ratios (compressed / raw bytes). A
whole text outside its band, or a text with more than a given share of chunks
outside the chunk band, is rejected. The chunks are the whole ones and, if bytes
are left over, the last of that size, so every byte of a longer text is judged;
a text shorter than a chunk is judged as a whole only.

The bands were read off labelled prose in four languages: the lowest and highest
ratios of good documents of each length class (below 160 bytes: of beginnings of
such documents), widened by some hundredths. Above the last class the floor
falls with each doubling, as it does for such prose joined to longer texts (read
off up to 1.6 MB). Letters of small alphabets other than Latin count as one byte
each (:func:`view`), so the bands hold for them too.

Null text: no words, base fails. Empty text: likewise. Ties and repeated rows
get equal values row by row; an empty table gives an empty table. Extra columns
are ignored by the query and kept by :func:`filter_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import as_bytes, gram_hashes, text_col, word_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """(least bytes, lowest ratio, highest ratio) by length, and the chunk rule."""

    whole: tuple = ((0, 0.0, 2.0), (40, 0.90, 1.3), (60, 0.75, 1.2), (80, 0.66, 1.17), (120, 0.59, 1.03), (160, 0.50, 1.2), (400, 0.455, 0.95), (1500, 0.41, 0.80), (6000, 0.38, 0.70), (24000, 0.355, 0.66))
    #: By so much the floor falls with each doubling above the last class.
    falls: float = 0.011
    chunk_bytes: int = 2048
    chunk: tuple = (0.40, 0.80)
    #: Rejected if more than this share of the chunks leaves the chunk band.
    bad_share: float = 0.34
    level: int = 3


def view(raw: bytes) -> bytes:
    """The bytes whose ratios are taken: a letter of U+0280 to U+1FFF as one byte, all else as it is.

    Such alphabets lie in blocks of 128 code points, of which the place is kept.
    """
    data = np.frombuffer(raw, np.uint8)
    two = np.flatnonzero((data >= 0xCA) & (data <= 0xDF))
    three = np.flatnonzero((data == 0xE0) | (data == 0xE1))
    if not len(two) and not len(three):
        return raw
    out, keep = data.copy(), np.ones(len(data), bool)
    for at, width in ((two, 2), (three, 3)):
        out[at] = 0x80 | (data[at + width - 2] & 1) << 6 | data[at + width - 1] & 0x3F
        for k in range(1, width):
            keep[at + k] = False
    return out[keep].tobytes()


def compression(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their band, and the verdict (True: keep)."""
    raw = view(raw)
    n = len(raw)
    if not n:
        return 0.0, 0, 0, True
    ratio = len(packer.compress(raw)) / n
    low, high = next((lo, hi) for least, lo, hi in reversed(bands.whole) if n >= least)
    low -= bands.falls * max(0.0, math.log2(n / bands.whole[-1][0]))
    size, bad = bands.chunk_bytes, 0
    starts = [*range(0, n - size + 1, size), *([n - size] if n > size and n % size else [])]
    for k in starts:
        r = len(packer.compress(raw[k : k + size])) / size
        bad += not bands.chunk[0] <= r <= bands.chunk[1]
    chunks = len(starts)
    return ratio, chunks, bad, low <= ratio <= high and bad <= bands.bad_share * chunks


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, words = word_hashes(data)
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    first = (data & 0xC0) != 0x80  # one byte of each code point
    gaps = int(first.sum()) - int(first[(data > 32) | ((data < 9) | ((data > 13) & (data < 32)))].sum())
    chars = int(first.sum()) - gaps
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n >= 9:
        grams = gram_hashes(words, 8)
        order = np.argsort(grams, kind="stable")
        s = grams[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(grams) + 1, bool)
            twice[:-1][order[1:][same]] = True
            twice[:-1][order[:-1][same]] = True
            at = np.flatnonzero(twice)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 8, -1)
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    return n, chars, int(_SYMBOL[data].sum()), dup, repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, bad_chunks long"
)


def _measure(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = as_bytes(text.as_py()).tobytes()
                base = base_counts(raw)
                failed = base_failed(base[0], base[4])
                ratio, chunks, bad, good = compression(raw, bands, packer)
                rows.append((*base, failed, good and not failed, ratio, chunks, bad))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *_NAMES])

    return run


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def measure(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id with the base counts, the compression figures and the verdict."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col(docs).alias("text"))
    return d.mapInArrow(_measure(bands), f"doc_id long, {SCHEMA}")


def filter_documents(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` whose text passes, all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            keep = []
            for text in batch.column(at):
                raw = as_bytes(text.as_py()).tobytes()
                base = base_counts(raw)
                keep.append(not base_failed(base[0], base[4]) and compression(raw, bands, packer)[3])
            yield batch.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
