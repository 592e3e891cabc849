import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec, text
from tidelog.operators import tables
from tidelog.sources import segments
from tidelog.streaming import stateful
from tidelog.streaming.sink import TableSink


def test_crc32c_known_value(spark):
    assert codec.crc32c(b"123456789") == 0xE3069283
    df = spark.createDataFrame([(b"123456789",), (b"",), (None,), (b"abc" * 50,)], "b binary")
    assert [r[0] for r in df.select(codec.crc32c_udf("b")).collect()] == [0xE3069283, 0, 0, codec.crc32c(b"abc" * 50)]


@pytest.mark.parametrize("extra", [{}, {"subject": b"a.b"}, {"tag": b"s1"}, {"payload": b"x" * 70_000}])
def test_frame_round_trip(extra):
    raw = codec.encode_frame(7, 99, b"k", b"h", **{"payload": b"pay", **extra})
    rec, used, why = codec.decode_frame(raw)
    assert (why, used, rec["seq"], rec["key"], rec["headers"]) == ("ok", len(raw), 7, b"k", b"h")
    for k in (0, 5, 33, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[k] ^= 0xFF
        assert codec.decode_frame(bytes(bad))[0] is None
    assert codec.decode_frame(raw[:-1])[2] == "torn_tail"


def test_segment_scan_keeps_the_valid_prefix(spark, tmp_path):
    frames = [codec.encode_frame(100 + k, k, b"k", payload=b"p%d" % k) for k in range(5)]
    whole = codec.encode_segment(1, 50, 100, frames)
    (tmp_path / "seg-1.log").write_bytes(whole)
    hurt = bytearray(codec.encode_segment(2, 55, 100, frames))
    hurt[64 + len(frames[0]) + len(frames[1]) + 40] ^= 1
    (tmp_path / "seg-2.log").write_bytes(bytes(hurt))
    (tmp_path / "seg-3.log").write_bytes(b"junk")
    got = segments.scan(spark, str(tmp_path))
    assert sorted(r["offset"] for r in segments.records(got).collect()) == [50, 51, 52, 53, 54, 55, 56]
    assert sorted(r["reason"] for r in segments.losses(got).collect()) == ["corrupt_record_body", "corrupt_segment_header"]


def test_compacted_segment_keeps_its_offsets(spark, tmp_path):
    kept = [100, 103, 104, 109]
    frames = [codec.encode_frame(q, q, b"k", payload=b"p%d" % q) for q in kept]
    whole = codec.encode_segment(3, 50, 100, frames, covered=(48, 62, 98, 112, 5), last_seq=109)
    (tmp_path / "seg-3.log").write_bytes(whole)
    got = segments.scan(spark, str(tmp_path))
    assert sorted(r["offset"] for r in segments.records(got).collect()) == [50, 53, 54, 59]
    assert segments.losses(got).count() == 0
    assert codec.covered_span(whole) == (48, 62, 98, 112, 5)
    assert [loss["reason"] for _, loss in codec.read_segment(whole[:-1]) if loss] == ["torn_tail"]
    falling = codec.encode_segment(3, 50, 100, frames[::-1], covered=(48, 62, 98, 112, 5), last_seq=109)
    assert [loss["reason"] if loss else rec["offset"] for rec, loss in codec.read_segment(falling)] == [59, "sequence_gap"]


def test_metrics_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP x\nup 1\nreq_total{job="a",code="200"} 12.5\nbad line here\n')
    rows = {r["metric"]: (r["labels"], r["sample"]) for r in segments.metrics(spark, str(tmp_path)).collect()}
    assert rows == {"up": (None, 1.0), "req_total": ({"job": "a", "code": "200"}, 12.5)}


def _batch(spark, a, b):
    return spark.range(a, b).select(F.col("id").alias("offset"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit(0).alias("flags"), *[F.lit(b"x").alias(c) for c in ("key", "headers", "payload")])


def test_sink_is_idempotent(spark, tmp_path):
    sink = TableSink(spark, str(tmp_path / "t"))
    sink.append(_batch(spark, 0, 10))
    sink.append(_batch(spark, 0, 10))
    sink.append(_batch(spark, 5, 15))
    assert sink.next_offset() == 15
    assert tuple(tables.contiguity(sink.read()).first())[2:] == (15, True, True)
    with pytest.raises(ValueError):
        sink.append(_batch(spark, 20, 22).union(_batch(spark, 20, 22)))
    assert sink.compact(str(tmp_path / "c"), 1).count() == 15


def test_sink_survives_a_crash_between_files(spark, tmp_path):
    sink = TableSink(spark, str(tmp_path / "t"))
    sink.append(_batch(spark, 0, 10))
    whole, mark = _batch(spark, 10, 30), sink._mark
    sink._mark = lambda *_: (_ for _ in ()).throw(RuntimeError("killed before the mark"))
    with pytest.raises(RuntimeError):
        sink.append(whole.filter("offset >= 25"))  # only the file with the high offsets got out
    sink._mark = mark
    assert sink.next_offset() == 10 and sink.read().count() == 10
    sink.append(whole)
    sink.append(whole)
    assert sorted(r[0] for r in sink.read().select("offset").collect()) == list(range(30))


def test_sink_drains_a_stream(spark, tmp_path):
    _batch(spark, 0, 30).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_batch(spark, 0, 1).schema).parquet(str(tmp_path / "in"))
    sink = TableSink(spark, str(tmp_path / "out"))
    for _ in range(2):
        sink.drain(stream, str(tmp_path / "ck")).awaitTermination()
    assert sink.read().count() == 30


def test_keyed_stream_keeps_state_across_batches(spark, tmp_path):
    schema = "id string, at long, epoch long, seq long"
    for k, rows in enumerate([[("p", 1, 1, 5), ("q", 1, 1, 1)], [("p", 2, 1, 5), ("p", 3, 1, 6), ("q", 2, 0, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = stateful.keyed(stream, "id", "at", ["epoch", "seq", "at"], stateful.Sequence, "id string, at long, decision string, detail long")
    made.writeStream.format("memory").queryName("seqs").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.table("seqs").collect()
    assert {(r["id"], r["at"], r["decision"]) for r in out} == {("p", 1, "fresh"), ("q", 1, "fresh"), ("p", 2, "duplicate"), ("p", 3, "fresh"), ("q", 2, "fenced")}


def test_streaming_dedup_matches_the_fold():
    from tidelog.operators.folds import dedup_machine

    a, b = stateful.Dedup(3, 50), dedup_machine(3, 50)()
    for k in range(200):
        args = (1 + k // 90, f"m{k * 7 % 5}", k, k * 3)
        assert a.step(*args) == b(*args)


def test_text_functions(spark):
    raw = spark.createDataFrame([("5s",), ("3d",), ("7",), ("2MB",), ("99999999999999999d",), ("4KiB",)], "x string")
    assert [tuple(r) for r in raw.select(text.duration_ms(F.col("x")), text.byte_size(F.col("x"))).collect()] == [(5000, None), (259_200_000, None), (None, None), (None, None), (None, None), (None, 4096)]
    up = spark.createDataFrame([(0,), (61,), (90_061,)], "s long")
    assert [r[0] for r in up.select(text.uptime(F.col("s"))).collect()] == ["0s", "1m 1s", "1d 1h 1m 1s"]
