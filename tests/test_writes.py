"""Appends, outcomes, cold objects and command output at their edges."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions import names
from tidelog.operators import writes
from tidelog.sources.cold import ColdStore


def test_commit_rejects_holes_and_repeats(spark):
    heads = spark.createDataFrame([("a", 0, 5), ("b", 0, 0), ("c", 0, 2), ("idle", 0, 9)], "stream string, partition int, head long")
    rows = [("a", 0, o) for o in (5, 6)] + [("b", 0, o) for o in (0, 2)] + [("c", 0, o) for o in (2, 3, 3)] + [("new", 1, 0)]
    got = {r.stream: (r.outcome, r.appended, r.next_offset) for r in writes.commit_outcomes(spark.createDataFrame(rows, "stream string, partition int, offset long"), heads).collect()}
    assert got == {"a": ("committed", 2, 7), "b": ("rejected", 0, 0), "c": ("rejected", 0, 2), "idle": ("unchanged", 0, 9), "new": ("committed", 1, 1)}


def test_lines(spark):
    texts = ["", "\n", "a", "a\n", "a\n\nb", "a\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(names.lines_of(F.col("t"))).collect()]
    assert got == [[], [""], ["a"], ["a"], ["a", "", "b"], ["a", ""]]
    odd = 'q"\\\n\x01é'
    r = spark.createDataFrame([(odd,)], "t string").select(names.success_envelope("s", F.col("t")).alias("e")).first()
    assert json.loads(r.e) == {"schema": "s", "ok": True, "exit_code": 0, "data": {"stdout": odd, "lines": ['q"\\', "\x01é"]}}


def test_headroom_of_large_ceilings(spark):
    big = 2**62
    r = spark.range(1).select(writes.headroom_permille(F.lit(big), F.lit(big // 2)).alias("p"), writes.fits([F.lit(big)] * 4, F.lit(2**63 - 1)).alias("f"), writes.headroom(F.lit(5), F.lit(9)).alias("h")).first()
    assert (r.p, r.f, r.h) == (500, False, 0)


@pytest.mark.parametrize("uri", ["", "file://"])
def test_cold_store(tmp_path, uri):
    cold = ColdStore(uri + str(tmp_path / "cold"))
    assert cold.list() == [] and not cold.exists("a/x") and not cold.delete("a/x")
    cold.put("a/x", b"0123456789")
    cold.put("a/x", b"0123456789")
    cold.put("b", b"")
    assert cold.list() == [("a/x", 10), ("b", 0)] and cold.list("a/") == [("a/x", 10)]
    assert cold.get("a/x") == b"0123456789" and cold.get("a/x", 3, 4) == b"3456" and cold.get("a/x", 8, 99) == b"89" and cold.get("a/x", 50, 1) == b"" and cold.get("b") == b""
    assert cold.delete("a/x") and not cold.exists("a/x")
    for bad in ("", "/etc/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            cold.put(bad, b"")
    with pytest.raises(FileNotFoundError):
        cold.get("a/x")
