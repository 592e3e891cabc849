"""Boundaries of operators on small tables made by hand."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import admin, monitor, ordered, reads, replicas, reports, tables
from tidelog.operators.scan import running

REC = "stream string, partition int, segment_id long, offset long, timestamp_ms long, key string, payload string, ttl_ms long, due_ms long"


def rec(spark, *rows):
    return spark.createDataFrame([("s", 0, o // 4, o, t, k, p, ttl, due) for o, t, k, p, ttl, due in rows], REC)


def test_expiry_is_inclusive(spark):
    df = rec(spark, (0, 100, "k", "p", 50, 0), (1, 101, "k", "p", 50, 0), (2, 0, "k", "p", 0, 0))
    assert [r["offset"] for r in reads.live(df, 150).orderBy("offset").collect()] == [1, 2]


def test_delay_holds_the_head_of_the_line(spark):
    df = rec(spark, (0, 0, "k", "p", 0, 10), (1, 0, "k", "p", 0, 99), (2, 0, "k", "p", 0, 5))
    assert [r["offset"] for r in reads.due_prefix(df, 10).collect()] == [0]


def test_tombstones_age_strictly(spark):
    df = rec(spark, (0, 0, "a", "x", 0, 0), (1, 100, "a", "", 0, 0), (2, 99, "b", "", 0, 0), (3, 0, "", "", 0, 0), (4, 0, "c", "1", 0, 0))
    assert [r["offset"] for r in ordered.compact(df, 150, 50).orderBy("offset").collect()] == [1, 3, 4]


def test_a_window_always_gives_one_record(spark):
    df = rec(spark, *[(k, 0, "k", "p" * 10, 0, 0) for k in range(9)])
    assert [r["offset"] for r in reads.offset_window(df, 3, 5, 1).collect()] == [3]
    assert [r["offset"] for r in reads.offset_window(df, 3, 5, 25).orderBy("offset").collect()] == [3, 4]


def test_seek_is_by_offset(spark):
    df = rec(spark, (0, 10, "k", "p", 0, 0), (1, 30, "k", "p", 0, 0), (2, 20, "k", "p", 0, 0), (3, 40, "k", "p", 0, 0), (4, 5, "k", "p", 0, 0))
    assert [r["offset"] for r in reads.seek_by_time(df, 25).orderBy("offset").collect()] == [1, 2, 3, 4]
    assert [r["offset"] for r in reads.seek_by_time(df, 25, 40).orderBy("offset").collect()] == [1, 2]


def test_filtered_gaps_cover_what_is_not_delivered(spark):
    df = rec(spark, *[(k, 0, "k", "ab", 0, 0) for k in range(12)])
    gaps = sorted((r["from"], r["to"], r["records"]) for r in reads.filtered_gaps(df, F.col("offset").isin(0, 5, 6)).collect())
    assert gaps == [(1, 5, 4), (7, 12, 5)]


@pytest.mark.parametrize(("acked", "committed", "ahead"), [([0, 1, 2], 3, []), ([1, 2, 5], 0, [(1, 3), (5, 6)]), ([0, 2, 3, 9, 2], 1, [(2, 4), (9, 10)])])
def test_ack_cursor(spark, acked, committed, ahead):
    df = spark.createDataFrame([("g", a) for a in acked], "group string, offset long")
    r = reads.ack_cursor(df).first()
    assert (r["committed"], [(x["start"], x["end"]) for x in r["ahead"]]) == (committed, ahead)


def test_running_carries_over_segments(spark):
    df = rec(spark, *[(k, (k * 7) % 11, "k", "p", 0, 0) for k in range(14)])
    got = [(r["a"], r["b"]) for r in running(running(df, ["stream"], "segment_id", "offset", F.lit(1), "sum", "a"), ["stream"], "segment_id", "offset", F.col("timestamp_ms"), "max", "b").orderBy("offset").collect()]
    times = [(k * 7) % 11 for k in range(14)]
    assert got == [(k + 1, max(times[: k + 1])) for k in range(14)]


def test_quorum_needs_enough_in_sync(spark):
    df = spark.createDataFrame([("p", True, 100), ("p", False, 90), ("p", False, 10), ("q", True, 50)], "part string, is_leader boolean, end long")
    got = {r["part"]: (r["high_watermark"], r["in_sync"]) for r in replicas.quorum_mark(df, ["part"], 2, 20).collect()}
    assert got == {"p": (90, 2), "q": (None, 1)}


def test_read_tiers(spark):
    rows = [("committed", 5, 9, 7), ("committed", 7, 9, 7), ("latest", 7, 9, 7), ("latest", 6, 9, 7), ("leader", 0, 9, 7), ("latest", 9, 9, 7)]
    df = spark.createDataFrame(rows, "t string, a long, b long, s long")
    got = [r[0] for r in df.select(replicas.read_decision(F.col("t"), F.col("a"), F.col("b"), F.col("s"))).collect()]
    assert got == ["serve_local", "nothing", "confirm_with_leader", "serve_local", "confirm_with_leader", "nothing"]


def test_mirror_stops_at_a_gap_and_at_damage(spark):
    df = spark.createDataFrame([("s", 0, 10, 10), ("s", 10, 10, 4), ("s", 20, 10, 10), ("t", 5, 10, 10)], "stream string, first_offset long, n long, valid long")
    got = {(r["stream"], r["first_offset"]): (r["accepted"], r["appended"]) for r in tables.mirror(df, 0, 3).collect()}
    assert got == {("s", 0): (True, 7), ("s", 10): (True, 4), ("s", 20): (False, 0), ("t", 5): (False, 0)}


def test_counter_reset_counts_from_zero(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 10, 9), ("a", 20, 2), ("a", 30, 2)], "s string, ts long, value long")
    assert monitor.increase(df, ["s"], 100).first()["increase"] == 6


def test_alert_needs_to_hold(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in ((0, 9), (10, 9), (20, 1), (30, 9), (40, 9), (50, 9))], "s string, ts long, value long")
    assert [tuple(r) for r in monitor.held(df, ["s"], F.col("value") > 5, 20).collect()] == [("a", 30, 50)]


def test_retention_keeps_the_newest_and_what_is_not_committed(spark):
    seg = spark.createDataFrame([("s", 0, k, 10, 100, 0, (k + 1) * 10) for k in range(5)], "stream string, partition int, segment_id long, records long, bytes long, last_ms long, end long")
    floor = spark.createDataFrame([("s", 0, 25)], "stream string, partition int, committed long")
    assert sorted(r["segment_id"] for r in ordered.retention(seg, floor, 0, 0, 1, 10**6).collect()) == [0, 1]


def test_regression_gate(spark):
    schema = "device string, unix_secs long, throughput double, p99 double, p999 double, warmup_ok boolean"
    now = 1_700_000_000
    cur = spark.createDataFrame([("a", now, 89.0, 100.0, 100.0, True), ("b", now, 100.0, 114.0, 125.0, True), ("c", now, 1.0, 1.0, 1.0, False)], schema)
    base = spark.createDataFrame([(x, now - 10**7, 100.0, 100.0, 100.0, True) for x in "abc"], schema)
    assert {r["device"]: r["outcome"] for r in reports.regression_gate(cur, base, now).collect()} == {"a": "fail", "b": "pass"}


def test_admin(spark):
    df = spark.createDataFrame([(0,), (1,), (4,), (8,), (12,)], "f int")
    assert [r[0] for r in df.select(admin.ack_level(F.col("f"), 1, 12, 2)).collect()] == ["server_ack", "no_ack", "no_ack", "server_and_client_ack", "server_ack"]
    d = spark.createDataFrame([("@east/o/x",), ("@east",), ("east",)], "s string").select(admin.domain_ref(F.col("s")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in d] == [("east", "o/x"), ("east", ""), None]


def test_backup_manifest(spark, tmp_path):
    import zlib

    (tmp_path / "a.bin").write_bytes(b"hello")
    m = admin.manifest(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [tuple(r) for r in m] == [("a.bin", zlib.crc32(b"hello"), 5)]


def test_gate_outcomes(spark):
    schema = "device string, unix_secs long, throughput double, p99 double, p999 double, warmup_ok boolean"
    now = 1_700_000_000
    base = spark.createDataFrame([("a", now - 10**7, 100.0, 100.0, 100.0, True)], schema)

    def outcome(rows, before=base, **more):
        return tuple(reports.gate_outcome(spark.createDataFrame(rows, schema), before, now, **more).first())

    slow, cold = [("a", now, 89.0, 100.0, 100.0, True)], [("a", now, 1.0, 1.0, 1.0, False)]
    assert outcome(slow) == ("fail", 1)
    assert outcome(slow, ratified="known cause") == ("ratified", 1)
    assert outcome([("a", now, 91.0, 100.0, 100.0, True)]) == ("pass", 0)
    assert outcome(cold) == ("insufficient_data", 0)
    assert outcome(slow, base.limit(0)) == ("no_baseline", 0)
