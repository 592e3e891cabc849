"""Kept states of machines, merged sinks, restored backups, and functions in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import names, sampling, sql
from tidelog.operators import admin, cluster, folds, reads, reports, routing
from tidelog.streaming import stateful
from tidelog.streaming.sink import TableSink

OPS = ["claim", "ack", "extend", "nack", "defer", "release_below"]
MACHINES = {
    "sequence": (folds.sequence_machine, lambda r, k: (1 + k // 70, r.randrange(k // 4 + 1), k)),
    "dedup": (folds.dedup_machine(4, 50), lambda r, k: (1 + k // 90, f"m{r.randrange(6)}", k, k * 3)),
    "lease": (folds.lease_machine(30, 100), lambda r, k: (r.choice(OPS), r.randrange(5), r.randrange(k + 1), k * 3, 7)),
    "key_shared": (folds.key_shared_machine, lambda r, k: (r.choice(["take", "ack"]), r.choice("ab "), r.randrange(9), 0, r.randrange(2))),
    "txn": (folds.txn_machine, lambda r, k: (r.choice(["prepare", "commit", "rollback"]),)),
    "confirm": (folds.confirm_machine(4, 30), lambda r, k: (r.choice(["register", "register", "commit", "expire"]), k, k * 4)),
    "codel": (folds.codel_machine(5, 20), lambda r, k: (r.randrange(30), k * 4)),
    "aimd": (folds.aimd_machine(), lambda r, k: (r.random() < 0.8,)),
    "bucket": (folds.token_bucket_machine(100, 800, 20, 200), lambda r, k: (r.randrange(90), k * 10**6)),
    "retry": (folds.retry_budget_machine(3 * 10**9, 10**5), lambda r, k: (r.choice(["retry", "accept", "shed"]), k * 10**8)),
    "lockout": (folds.lockout_machine(2, 900, 600), lambda r, k: (r.random() < 0.6, k * 100)),
    "leaf": (cluster.leaf_machine, lambda r, k: (k * 2, 4, r.choice([2, 4]))),
}


@pytest.mark.parametrize("name", MACHINES)
def test_a_machine_goes_on_from_its_kept_state(name):
    make, event = MACHINES[name]
    rng = random.Random(name)
    events = [event(rng, k) for k in range(200)]
    whole, part = make(), make()
    for k, e in enumerate(events):
        if k % 13 == 12:
            part = stateful.thaw(make(), stateful.freeze(part))
        assert part(*e) == whole(*e)


def test_leases_in_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"g{k % 2}", k, rng.choice(OPS), rng.randrange(3), rng.randrange(k + 1), k * 3, 7) for k in range(60)]
    schema = "g string, n long, op string, offset long, generation long, now long, delay long"
    for b in range(3):
        spark.createDataFrame(rows[b * 20 : b * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{b}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = "g string, n long, outcome string, generation long, deadline long, deliveries long"
    columns = ["op", "offset", "generation", "now", "delay"]
    made = stateful.keyed(stream, "g", "n", columns, folds.lease_machine(30, 100), out)
    made.writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    batch = folds.fold(spark.createDataFrame(rows, schema), ["g"], ["n"], columns, folds.lease_machine(30, 100), out)
    assert sorted(map(str, spark.table("leases").collect())) == sorted(map(str, batch.collect()))


def test_merged_sink_reads_the_same(spark, tmp_path):
    sink = TableSink(spark, str(tmp_path / "t"))
    for k in range(3):
        sink.append(spark.range(k * 10, k * 10 + 10).selectExpr("id as offset", "id as timestamp_ms", "0 as flags", "cast(null as binary) as key", "cast(null as binary) as headers", "cast(id as string) as payload"))
    before = sorted(map(str, sink.read().collect()))
    sink.merge(2)
    assert sink.snapshots() == 1 and sink.next_offset() == 30 and sorted(map(str, sink.read().collect())) == before
    assert sink.expire() == 3 and sink.expire() == 0
    assert sorted(map(str, TableSink(spark, str(tmp_path / "t")).read().collect())) == before
    sink.append(sink.read().withColumn("offset", F.col("offset") + 25))  # what is there is dropped
    assert sink.snapshots() == 2 and sink.next_offset() == 55 and sink.read().count() == 55
    sink.merge(1)
    sink.expire()
    assert sorted(r.offset for r in sink.read().collect()) == list(range(55))


def test_restore_finds_faults(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n * 5)
    read = lambda: spark.read.format("binaryFile").load(str(tmp_path))
    listed = spark.createDataFrame([tuple(r) for r in admin.manifest(read()).collect()], "file string, crc32 long, length long")
    assert admin.restore_faults(read(), listed).count() == 0
    (tmp_path / "a").unlink()
    (tmp_path / "b").write_text("bbbbx")
    (tmp_path / "d").write_text("d")
    assert {tuple(r) for r in admin.restore_faults(read(), listed).collect()} == {("a", "missing"), ("b", "damaged"), ("d", "unlisted")}


def test_sql_functions_equal_columns(spark):
    known = sql.register(spark)
    df = spark.createDataFrame([("", 0, 5.0), ("k1", 7, -1.0), ("ü", 2**40, float("nan")), ("ERR_STORAGE", 3, float("inf")), ("OK", 1, 0.0)], "s string, n long, x double")
    df.createOrReplaceTempView("scalars")
    both = {
        "tl_key_hash(s)": routing.key_hash(F.col("s")),
        "tl_partition(s, 7)": routing.partition_of(F.col("s"), 7),
        "tl_effective_ttl(n, 4)": reads.effective_ttl(F.col("n"), F.lit(4)),
        "tl_occupancy(x, 2)": reports.occupancy(F.col("x"), F.lit(2.0)),
        "tl_segment_file(n)": names.segment_file(F.col("n")),
        "tl_partition_folder(3)": names.partition_folder(F.lit(3)),
        "tl_cursor_file(s)": names.cursor_file(F.col("s")),
        "tl_is_error(s)": names.is_error(F.col("s")),
        "tl_fsync_admits(n, 5, 8)": cluster.admits(F.col("n"), F.lit(5), 8),
        "tl_trace_position(n)": sampling.position(F.col("n")),
    }
    assert {k.split("(")[0] for k in both} == set(known)
    for text, column in both.items():
        got, want = spark.sql(f"SELECT n, {text} AS v FROM scalars"), df.select("n", column.alias("v"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), text
