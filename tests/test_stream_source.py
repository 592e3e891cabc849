"""The streaming source by offset, the chain of segments and the committing consumer."""

import pytest

from tidelog.functions import codec
from tidelog.sources import stream


def put(folder, segment_id, base, n, sealed=True):
    frames = [codec.encode_frame(base + i, 1000 + i, key=b"k", payload=f"p{base + i}".encode()) for i in range(n)]
    raw = codec.encode_segment(segment_id, base, base, frames)
    (folder / f"seg-{segment_id:016x}.log").write_bytes(raw if sealed else raw[: -codec.SEGMENT_FOOTER])


def test_chain_ends_at_a_hole(tmp_path):
    assert stream.bounds(str(tmp_path)) == (0, 0)
    put(tmp_path, 1, 50, 5)
    put(tmp_path, 2, 55, 3, sealed=False)
    assert stream.bounds(str(tmp_path)) == (50, 58) and stream.chain(str(tmp_path))[1] is None
    put(tmp_path, 4, 60, 2)
    spans, broken = stream.chain("file://" + str(tmp_path))
    assert [(s.base, s.end) for s in spans] == [(50, 55), (55, 58)] and broken.endswith("4.log")
    (tmp_path / "seg-0000000000000004.log").write_bytes(b"junk")
    assert stream.chain(str(tmp_path))[1].endswith("4.log")


@pytest.mark.parametrize("uri", ["", "file://"])
def test_stream_goes_on_where_it_stopped(spark, tmp_path, uri):
    log, out, state = tmp_path / "log", [], {"at": 0}
    log.mkdir()
    put(log, 1, 50, 5)
    put(log, 2, 55, 3)
    stream.register(spark)

    def handle(rows, a, z):
        out.append((a, z, sorted(r.offset for r in rows.collect())))

    take = stream.Consumer(handle, lambda: state["at"], lambda z: state.update(at=z), window=4)

    def drain():
        df = spark.readStream.format("tidelog").option("path", uri + str(log)).option("start", 52).load()
        q = df.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    drain()
    assert out == [(52, 56, [52, 53, 54, 55]), (56, 58, [56, 57])] and state["at"] == 58
    put(log, 3, 58, 3)
    drain()
    assert out[2:] == [(58, 61, [58, 59, 60])] and state["at"] == 61
    drain()
    assert len(out) == 3


def test_consumer_repeats_only_what_was_not_committed(spark):
    batch = spark.createDataFrame([(i,) for i in range(10)], "offset long")
    done, state = [], {"at": 0}

    def handle(rows, a, z):
        if a == 6 and not state.get("again"):
            state["again"] = True
            raise RuntimeError("lost")
        done.append((a, rows.count()))

    take = stream.Consumer(handle, lambda: state["at"], lambda z: state.update(at=z), window=2, every=2)
    with pytest.raises(RuntimeError):
        take(batch, 0)
    assert done == [(0, 2), (2, 2), (4, 2)] and state["at"] == 4
    take(batch, 0)
    assert done[3:] == [(4, 2), (6, 2), (8, 2)] and state["at"] == 10
    take(batch, 0)
    assert len(done) == 6
