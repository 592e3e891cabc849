"""Numbering and ranges cut at blocks give what one window over the whole log gives."""

import random

from pyspark.sql import functions as F

from tidelog.operators import reports, tables
from tidelog.operators.ordered import drain_turns
from tidelog.operators.reads import offset_window
from tidelog.operators.scan import islands, ranked


def test_islands_across_blocks(spark):
    rng = random.Random(5)
    held = {g: sorted(rng.sample(range(60), k)) for g, k in (("a", 50), ("b", 9), ("c", 60))}
    df = spark.createDataFrame([(g, o) for g, os in held.items() for o in os + os[:3]], "g string, o long")
    got = {}
    for r in islands(df, ["g"], "o", width=4).collect():
        got.setdefault(r.g, []).append((r.start, r.end))
    for g, os in held.items():
        want = [(o, next(e for e in range(o, 99) if e not in os)) for o in os if o - 1 not in os]
        assert sorted(got[g]) == want


def test_ranks_and_fan_in(spark):
    rng = random.Random(6)
    rows = [(g, o) for g in "xy" for o in rng.sample(range(1000), 80)]
    df = spark.createDataFrame(rows, "stream string, k long")
    want = {(g, o): i + 1 for g in "xy" for i, o in enumerate(sorted(o for h, o in rows if h == g))}
    assert {(r.stream, r.k): r.n for r in ranked(df, ["stream"], "k", "n", width=16).collect()} == want
    both = tables.fan_in([df, df.filter("k > 500")], "k", width=16)
    for g in "xy":
        got = [(r.offset, r.k) for r in both.filter(F.col("stream") == g).orderBy("offset").collect()]
        keys = sorted([o for h, o in rows if h == g] + [o for h, o in rows if h == g and o > 500])
        assert got == list(enumerate(keys))


def test_drain_turns(spark):
    rng = random.Random(7)
    rows = [("s", 0, o // 8, o, rng.randrange(3)) for o in range(60)]
    df = spark.createDataFrame(rows, "stream string, partition int, segment_id long, offset long, lane int")
    want = {r[3]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[4], r[3])))}
    assert {r.offset: r.turn for r in drain_turns(df, "lane").collect()} == want


def test_window_reads_open_segments_only(spark):
    rows = [("s", 0, o // 5, o, "x" * (o % 4)) for o in range(100)] + [("t", 0, 0, 0, "x" * 999), ("t", 0, 1, 7, None)]
    df = spark.createDataFrame(rows, "stream string, partition int, segment_id long, offset long, payload string")
    for most, size in ((1, 0), (7, 5), (1000, 40), (12, 10**6)):
        got = {s: sorted(r.offset for r in offset_window(df, 3, most, size).collect() if r.stream == s) for s in "st"}
        used, want = 0, []
        for r in rows[3:100]:
            used += len(r[4])
            if not want or len(want) < most and used <= size:
                want.append(r[3])
            else:
                break
        assert got["s"] == want and got["t"] == [7]


def test_approximate_percentiles_are_near(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    exact, near = reports.percentiles(df, ["g"], "v").first(), reports.percentiles(df, ["g"], "v", accuracy=1000).first()
    assert all(abs(exact[p] - near[p]) <= 21 for p in ("p50", "p99", "p999")) and exact["max"] == near["max"]
