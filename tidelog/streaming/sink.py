"""Idempotent table sink: the table's own marks decide what is new.

A batch is written into a folder of its own; then comes its mark, an empty file
whose name has the batch's number and the next offset, made in one step. Readers
see marked batches only. The stream's position comes last. So a crash while files
are written leaves a folder without a mark, which the next append writes anew, and
a crash after the mark brings the batch again, whose rows the mark then drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "offset long, timestamp_ms long, flags int, key binary, headers binary, payload binary"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


class TableSink:
    """Appends batches of records to ``path``, each stream partition in offset order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        """Hadoop file system and path of a name below the table."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _every_mark(self) -> list[tuple[int, int, int]]:
        """(batch, next offset, first batch it stands for) of all whole batches, in order."""
        fs, p = self._at("_marks")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        parts = [tuple(map(int, x.split("-"))) for x in names]
        return sorted((x[0], x[1], x[2] if len(x) > 2 else x[0]) for x in parts)

    def _marks(self) -> list[tuple[int, int]]:
        """(batch, next offset) of the batches that make up the table, in order."""
        marks = self._every_mark()
        hidden = {b for n, _, first in marks for b in range(first, n)}
        return [(b, n) for b, n, _ in marks if b not in hidden]

    def snapshots(self) -> int:
        """How many batches make up the table."""
        return len(self._marks())

    def merge(self, files: int) -> None:
        """Rewrite all batches as one of ``files`` files, in place.

        The new batch's mark names the batches it stands for, so readers change over
        in one step; a crash before that leaves a folder without a mark. What it
        replaced stays for readers that have begun, until :meth:`expire`.
        """
        marks = self._marks()
        if len(marks) < 2:
            return
        number = self._every_mark()[-1][0] + 1
        self.read().repartitionByRange(files, "offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(self._folder(number))
        self._mark(number, self.next_offset(), marks[0][0])

    def expire(self) -> int:
        """Delete batches that a merge replaced, their marks last but the merge's own; gives their number."""
        kept, gone = {b for b, _ in self._marks()}, 0
        for b, n, first in self._every_mark():
            if b not in kept:
                for name in (self._folder(b).removeprefix(self.path + "/"), f"_marks/{b:010d}-{n}" + (f"-{first}" if first != b else "")):
                    fs, p = self._at(name)
                    fs.delete(p, True)
                gone += 1
        return gone

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch-{batch:010d}"

    def read(self) -> DataFrame:
        """All rows of marked batches."""
        folders = [self._folder(b) for b, _ in self._marks()]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def next_offset(self) -> int:
        """One past the last offset of the table; 0 if there is none. Reads marks only."""
        return max((n for _, n in self._marks()), default=0)

    def append(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Append what the table does not hold yet; offsets of a batch must not repeat.

        One writer at a time. ``batch_id`` is the stream's own number: a query that
        starts over with a new checkpoint counts anew, so the marks decide, not it.
        """
        marks, start = self._marks(), self.next_offset()
        new = batch.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in SCHEMA.split(", ")]).filter(F.col("offset") >= start)
        if not new.groupBy("offset").count().filter("count > 1").isEmpty():
            raise ValueError("offsets of a batch are not strictly increasing")
        number = self._every_mark()[-1][0] + 1 if marks else 0
        folder = self._folder(number)
        new.repartitionByRange("offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(folder)
        last = self.spark.read.schema(SCHEMA).parquet(folder).agg(F.max("offset")).first()[0]
        if last is not None:
            self._mark(number, last + 1)

    def _mark(self, number: int, following: int, first: int | None = None) -> None:
        fs, p = self._at(f"_marks/{number:010d}-{following}" + (f"-{first}" if first is not None else ""))
        fs.mkdirs(p.getParent())
        if not fs.createNewFile(p):
            raise RuntimeError(f"batch {number} has a mark of another writer")

    def drain(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take all that is there now, then stop."""
        return stream.writeStream.foreachBatch(lambda df, i: self.append(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def follow(self, stream: DataFrame, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, i: self.append(df, i)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def compact(self, target: str, files: int) -> DataFrame:
        """Rewrite small files into ``files`` ranges of offsets at another path."""
        self.read().repartitionByRange(files, "offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)
