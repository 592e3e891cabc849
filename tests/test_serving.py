"""Serving, cluster and naming operators at their edges."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import names
from tidelog.operators import cluster, ordered, panels, serving


def records(spark, rows):
    return spark.createDataFrame(rows, "stream string, partition int, segment_id long, offset long, key string, payload string, timestamp_ms long")


def test_address_is_checked_before_the_read(spark):
    r = records(spark, [("a", 0, 0, i, "k", "xx", 0) for i in range(5)])
    catalog = spark.createDataFrame([("a", 2), ("empty", 1)], "stream string, partitions int")
    assert [x.offset for x in serving.read(r, catalog, "a", 0, 1, 3, 100).orderBy("offset").collect()] == [1, 2, 3]
    assert serving.read(r, catalog, "a", 1, 0, 3, 100).count() == 0
    assert serving.read(r, catalog, "empty", 0, 0, 3, 100).count() == 0
    with pytest.raises(serving.UnknownStream):
        serving.read(r, catalog, "b", 0, 0, 3, 100)
    for p in (-1, 2):
        with pytest.raises(serving.PartitionOutOfRange):
            serving.read(r, catalog, "a", p, 0, 3, 100)


def test_a_log_without_mark_has_flushed_nothing(spark):
    r = records(spark, [("a", 0, 0, 0, "", "", 0), ("b", 0, 0, 0, "", "", 0)])
    marks = spark.createDataFrame([("a", 0, 1)], "stream string, partition int, flushed long")
    assert [x.stream for x in serving.flushed(r, marks).collect()] == ["a"]


def test_run_of_ack_blocks(spark):
    acks = spark.createDataFrame([("g", i) for i in [*range(0, 7), *range(9, 30)]], "group string, offset long")
    asked = spark.createDataFrame([("g", i) for i in range(32)] + [("h", 0)], "group string, offset long")
    got = {(r.group, r.offset): r.state for r in serving.ack_state(asked, acks, width=4).collect()}
    assert len(got) == 33 and got["h", 0] == "open"
    assert [got["g", i] for i in (0, 6, 7, 8, 9, 29, 30)] == ["committed", "committed", "open", "open", "ahead", "ahead", "open"]


def test_dirty_run_needs_neighbours_and_dirt(spark):
    segments = "log string, segment_id long, base long, end long, compacted boolean"
    rows = [("l", 0, i // 4, i, "k", "x", 0) for i in range(16)]
    r = records(spark, rows).withColumnRenamed("stream", "log")

    def run(spans, **kw):
        s = spark.createDataFrame([("l", *x) for x in spans], segments)
        return sorted(x.segment_id for x in ordered.dirty_run(r, s, ["log"], 0, 1000, **kw).collect())

    whole = [(0, 0, 4, False), (1, 4, 8, False), (2, 8, 12, False), (3, 12, 16, False)]
    assert run(whole) == [0, 1, 2]  # never the newest
    assert run(whole, most=2) == [0, 1]
    assert run([(0, 0, 4, False), (1, 4, 8, True), (2, 8, 12, False), (3, 12, 16, False)]) == []  # a gap leaves one
    assert run(whole, least_permille=950) == []  # 11 of 12 rows go


def test_parked_acks_keep_their_order(spark):
    parked = spark.createDataFrame([("a", 0, i, o) for i, o in enumerate([0, 5, 1, 2])] + [("b", 0, 0, 0)], "stream string, partition int, seq long, offset long")
    commits = spark.createDataFrame([("a", 0, 3)], "stream string, partition int, commit long")
    got = {(r.stream, r.seq): r.released for r in cluster.release_acks(parked, commits).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): False, ("a", 3): False, ("b", 0): False}


def test_leaf_push():
    push = cluster.leaf_machine()
    assert push(0, 4, 4) == ("accepted", 4, 4)
    assert push(0, 4, 4) == ("known", 0, 4)
    assert push(2, 4, 3) == ("corrupt", 1, None)  # the one valid new frame stays
    assert push(2, 4, 4) == ("accepted", 1, 6)
    assert push(6, 0, 0) == ("known", 0, 6)


def test_names_come_back(spark):
    df = spark.createDataFrame([("",), ("a/b:ü",)], "g string")
    assert [r[0] for r in df.select(names.group_of(names.cursor_file(F.col("g")))).collect()] == ["", "a/b:ü"]
    odd = spark.createDataFrame([("seg-00000000000000ff.log",), ("seg-00000000000000FF.log",), ("seg-ff.log",), ("seg-ffffffffffffffff.log",), (None,)], "n string")
    got = [r[0] for r in odd.select(names.number_in(F.col("n"), names.SEGMENT_NAME).cast("string")).collect()]
    assert got == ["255", None, None, str(2**64 - 1), None]
    hexes = spark.createDataFrame([("6162",), ("616",), ("6A",), ("",)], "h string")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in hexes.select(names.from_hex(F.col("h"))).collect()] == [b"ab", None, None, b""]


def test_dead_letter_headers(spark):
    df = spark.createDataFrame([("grün", 2**40 + 7, 3, b"h\x00"), ("", 0, 0, b""), ("g" * 65536, 1, 1, b"")], "g string, o long, a int, h binary")
    packed = df.select("g", names.pack_dead_letter(b"MAGC", F.col("g"), F.col("o"), F.col("a"), F.col("h")).alias("p"))
    got = [r.u for r in packed.select(names.unpack_dead_letter(b"MAGC", F.col("p")).alias("u")).collect()]
    assert (got[0].group, got[0].source_offset, got[0].attempt, bytes(got[0].headers)) == ("grün", 2**40 + 7, 3, b"h\x00")
    assert (got[1].group, got[1].source_offset, bytes(got[1].headers)) == ("", 0, b"") and got[2] is None
    torn = packed.limit(1).select(names.unpack_dead_letter(b"MAGC", F.expr("substring(p, 1, octet_length(p) - 1)")).alias("u"))
    assert torn.first().u is None
    assert packed.limit(1).select(names.unpack_dead_letter(b"OTHR", F.col("p")).alias("u")).first().u is None


def test_panels_without_samples(spark):
    none = spark.createDataFrame([], "metric string, labels map<string,string>, sample long")
    assert panels.groups(none).count() == 0
    s = panels.storage(none).first()
    assert s.segments == 0 and s.write_amp is None and s.disk_free == 0
    assert panels.recovery(none).first().writer_healthy is False


def test_fencing(spark):
    row = spark.range(1)
    f = lambda *a: row.select(cluster.fenced(*[F.lit(x).cast("long") for x in a])).first()[0]
    assert not f(2, 2, 10, 9) and f(2, 2, 10, 10) and f(1, 2, 10, 9) and f(2, 2, None, 0)
