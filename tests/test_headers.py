from pyspark.sql import functions as F

from tidelog.functions import headers as h


def u64(n):
    return n.to_bytes(8, "little")


def test_delay_requests(spark):
    rows = [(b"DLY1" + u64(500) + b"rest",), (b"TTL1" + u64(9) + b"DLY1" + u64(7),), (b"DLY1" + u64(10_001),), (b"DUE1" + u64(5),), (b"plain",), (b"",)]
    df = spark.createDataFrame(rows, "x binary").select(h.resolve_delay(F.col("x"), F.lit(1000), 10_000).alias("r"), h.ttl_ms(F.col("x")).alias("t"))
    got = [(r["r"]["verdict"], r["r"]["headers"] and bytes(r["r"]["headers"]), r["t"]) for r in df.collect()]
    assert got == [
        ("delayed", b"DUE1" + u64(1500) + b"rest", None),
        ("delayed", b"TTL1" + u64(9) + b"DUE1" + u64(1007), 9),
        ("too_long", None, None),
        ("due_injected", None, None),
        ("unchanged", b"plain", None),
        ("unchanged", bytearray(b""), None),
    ]
    back = spark.createDataFrame([(b"DUE1" + u64(1500) + b"rest",)], "x binary").select(h.due_ms(F.col("x"))).first()[0]
    assert back == 1500


def test_compression_never_expands(spark):
    rows = [(b"a" * 1000,), (b"xyz",), (None,)]
    df = spark.createDataFrame(rows, "p binary").select("p", h.compress("p").alias("z")).select("p", "z.payload", "z.compressed", h.decompress("z.payload", "z.compressed").alias("back"))
    got = df.collect()
    assert [r["compressed"] for r in got] == [True, False, False]
    assert all(r["back"] == r["p"] for r in got) and len(got[0]["payload"]) < 100
    bad = spark.createDataFrame([(b"junk", True)], "p binary, c boolean").select(h.decompress("p", "c")).first()[0]
    assert bad is None


def test_encryption(spark):
    df = spark.createDataFrame([(b"secret", 3, 9)], "p binary, s long, c long")
    key, other = F.lit(b"0" * 32), F.lit(b"1" * 32)
    e = df.select("p", h.encrypt(F.col("p"), key, F.col("s"), F.col("c")).alias("e"))
    r = e.select("p", "e", h.decrypt(F.col("e"), key).alias("good"), h.decrypt(F.col("e"), other).alias("bad")).first()
    assert (bytes(r["good"]), r["bad"]) == (b"secret", None)
    assert len(r["e"]) == 12 + 6 + 16 and bytes(r["e"][:12]) == u64(3) + u64(9)[:4]


def test_admin_snapshot(spark):
    line = '{"version": 1, "streams": [{"name": "a", "earliest": 2, "head": 9}], "groups": [{"stream": "a", "name": "g", "committed": 4}, {"stream": "z", "name": "h", "committed": 1}]}'
    got = sorted(map(tuple, h.admin_snapshot(spark.createDataFrame([(line,), ("{bad",)], "value string")).collect()))
    assert got == [("a", "g", 4, 2, 9), ("z", "h", 1, None, None)]
