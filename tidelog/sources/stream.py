"""Streaming reads of a directory of segment files, by offset, and a consumer that commits as it goes.

``register(spark)`` makes the format ``tidelog`` known::

    spark.readStream.format("tidelog").option("path", folder).option("start", 100).load()

The stream's position is the next offset. A batch has all that is there; its tasks
read one segment each. What lies behind a hole of the chain is not served. Readers
list and open files with Arrow's file systems, on the driver and in the tasks alike.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidelog.functions import codec
from tidelog.sources.segments import RECORD

COLUMNS = [x.split()[0] for x in RECORD.split(", ")]
NAME = re.compile(r"seg-[^/]*\.log$")


class Span(NamedTuple):
    """A segment file and the offsets it stands for, end exclusive."""

    file: str
    segment_id: int
    base: int
    end: int


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(path)
    return arrow_fs.LocalFileSystem(), path.removeprefix("file:")


def _span(store: arrow_fs.FileSystem, file: str, magic: bytes) -> Span | None:
    """From header and footer alone; a file without a whole footer, or a compacted one, is read."""
    with store.open_input_file(file) as f:
        size = f.size()
        head = f.read_at(min(size, codec.SEGMENT_HEADER), 0)
        if len(head) < codec.SEGMENT_HEADER or head[:8] != magic or not codec._intact(head):
            return None
        segment_id, base_seq, base = struct.unpack_from("<QQQ", head, 12)
        if head[8] == codec.VERSION_COMPACTED:
            covered = codec.covered_span(f.read_at(size, 0))
            return covered and Span(file, segment_id, covered[0], covered[1])
        foot = f.read_at(codec.SEGMENT_FOOTER, size - codec.SEGMENT_FOOTER) if size >= codec.SEGMENT_HEADER + codec.SEGMENT_FOOTER else b""
        if foot and codec._intact(foot) and struct.unpack_from("<H", foot)[0] == codec.FOOTER_MAGIC and foot[4:12] == head[12:20]:
            last = struct.unpack_from("<Q", foot, 12)[0]
            return Span(file, segment_id, base, base + last - base_seq + 1)
        whole = sum(rec is not None for rec, _ in codec.read_segment(f.read_at(size, 0), magic))
        return Span(file, segment_id, base, base + whole)


def chain(path: str, magic: bytes = codec.SEGMENT_MAGIC) -> tuple[list[Span], str | None]:
    """Segments that follow each other without a hole, from the oldest on, and the first file that does not."""
    store, root = _open(path)
    listed = store.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    found = [(x.path, _span(store, x.path, magic)) for x in listed if x.is_file and NAME.search(x.path)]
    good: list[Span] = []
    for file, span in sorted(found, key=lambda x: (x[1] is None, x[1].base if x[1] else 0, x[0])):
        if span is None or good and span.base != good[-1].end:
            return good, file
        good.append(span)
    return good, None


def bounds(path: str, magic: bytes = codec.SEGMENT_MAGIC) -> tuple[int, int]:
    """Earliest retained offset and durable head; both 0 for a folder without segments."""
    spans, _ = chain(path, magic)
    return (spans[0].base, spans[-1].end) if spans else (0, 0)


class _Part(InputPartition):
    def __init__(self, span: Span, start: int, end: int):
        self.span, self.start, self.end = span, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, start: int, magic: bytes):
        self.path, self.start, self.magic = path, start, magic

    def initialOffset(self) -> dict:
        """The named start, or the oldest offset there is if that has gone."""
        return {"offset": max(self.start, bounds(self.path, self.magic)[0])}

    def latestOffset(self) -> dict:
        return {"offset": max(self.start, bounds(self.path, self.magic)[1])}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        a, z = start["offset"], end["offset"]
        return [_Part(s, a, z) for s in chain(self.path, self.magic)[0] if s.base < z and s.end > a]

    def read(self, part: _Part) -> Iterator[tuple]:
        store, file = _open(part.span.file if "://" not in self.path else self.path)
        with store.open_input_file(part.span.file) as f:
            raw = f.read_at(f.size(), 0)
        for rec, _ in codec.read_segment(raw, self.magic):
            if rec and part.start <= rec["offset"] < part.end:
                rec["path"] = part.span.file
                yield tuple(rec.get(c) for c in COLUMNS)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the query's checkpoint holds the position."""


class SegmentStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> _Reader:
        magic = self.options.get("magic")
        return _Reader(self.options["path"], int(self.options.get("start", 0)), magic.encode() if magic else codec.SEGMENT_MAGIC)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentStream)


class Consumer:
    """Takes a stream in windows of offsets and commits after every few of them.

    ``handle(rows, start, end)`` gets one window at a time, in order. ``load`` and
    ``save`` read and write the committed offset wherever the handler's results go.
    After a crash the windows since the last commit come again, none is left out.
    """

    def __init__(self, handle: Callable[[DataFrame, int, int], None], load: Callable[[], int], save: Callable[[int], None], window: int = 1000, every: int = 1):
        if window < 1 or every < 1:
            raise ValueError("window and every are at least 1")
        self.handle, self.load, self.save, self.window, self.every = handle, load, save, window, every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """A ``foreachBatch`` function. Windows are ranges of offsets, so nothing is sorted or collected."""
        left = batch.filter(F.col("offset") >= self.load())
        low, high = left.agg(F.min("offset"), F.max("offset")).first()
        if low is None:
            return
        starts = range(low, high + 1, self.window)
        for k, a in enumerate(starts, 1):
            z = min(a + self.window, high + 1)
            self.handle(left.filter(F.col("offset").between(a, z - 1)), a, z)
            if k % self.every == 0 or k == len(starts):
                self.save(z)
