"""Administration: resets, peeks, quarantine, admission, names, sharing, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.scan import running

LOG = ["stream", "partition"]


def reset_target(kind: Column, offset: Column, earliest: Column, head: Column) -> Column:
    """Where a cursor goes: earliest, latest, or an offset held within the durable range."""
    return F.when(kind == "earliest", earliest).when(kind == "latest", head).otherwise(F.least(F.greatest(offset, earliest), head))


def peek(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records of each stream as JSON lines.

    The n-th smallest offset of a stream bounds the scan before anything is
    sorted: only the first segments can hold it.
    """
    counts = records.groupBy("stream", "segment_id").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy("stream").orderBy("segment_id").rowsBetween(W.unboundedPreceding, -1))
    near = counts.withColumn("_b", F.coalesce(before, F.lit(0))).filter(F.col("_b") < n).select("stream", "segment_id")
    r = records.join(near, ["stream", "segment_id"], "left_semi")
    r = r.withColumn("_k", F.row_number().over(W.partitionBy("stream").orderBy("offset"))).filter(F.col("_k") <= n)
    return r.select("stream", "offset", F.to_json(F.struct("stream", "offset", "key", "subject", "payload")).alias("line"))


def newest_within(items: DataFrame, by: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Keep the newest items of each group whose sizes fit a cap: first in, first out."""
    w = W.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= cap).drop("_sum")


def admit_until_full(records: DataFrame, cap: int) -> DataFrame:
    """Whether each produced record still finds room below a byte cap of its log."""
    df = running(records, LOG, "segment_id", "offset", F.octet_length("payload").cast("long"), "sum", "_used")
    return df.withColumn("admitted", F.col("_used") <= cap).drop("_used")


def least_recent(touches: DataFrame, by: str, at: str, item: str, keep: int) -> DataFrame:
    """Items beyond the ``keep`` most recently touched of each group: what a bounded registry evicts."""
    last = touches.groupBy(by, item).agg(F.max(at).alias("last_touch"))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("last_touch"), item))
    return last.withColumn("_r", rank).filter(F.col("_r") > keep).drop("_r")


def ack_level(flags: Column, fire_bit: int, mask: int, shift: int) -> Column:
    """Acknowledgement level in flag bits: no_ack, server_and_client_ack, else server_ack."""
    level = F.shiftright(flags.bitwiseAND(F.lit(mask)), shift)
    return F.when(flags.bitwiseAND(F.lit(fire_bit)) != 0, "no_ack").when(level == 1, "no_ack").when(level == 2, "server_and_client_ack").otherwise("server_ack")


def domain_ref(spec: Column) -> Column:
    """``@domain/stream`` as a struct; null if it is no reference, an empty stream if none is named."""
    return F.when(spec.startswith("@"), F.struct(F.regexp_extract(spec, "^@([^/]*)", 1).alias("domain"), F.regexp_extract(spec, "^@[^/]*/(.*)$", 1).alias("stream")))


def unreachable(files: DataFrame, live: DataFrame) -> DataFrame:
    """Files that no live snapshot names."""
    return files.select("file").exceptAll(live.select("file").distinct())


def share(asked: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Resolve names across tenants: own, denied, or crossed to the owner's scoped name.

    ``asked``: tenant, name, access. ``imports``: tenant, local, owner, remote.
    ``exports``: owner, prefix, access ('both' for any), audience ('*' for any).
    The longest alias that is the name or ends at one of its dots wins.
    """
    a = asked.withColumn("_id", F.monotonically_increasing_id())
    i = imports.select(F.col("tenant").alias("_t"), "local", "owner", "remote")
    hit = (F.col("tenant") == F.col("_t")) & ((F.col("name") == F.col("local")) | F.col("name").startswith(F.concat(F.col("local"), F.lit("."))))
    j = a.join(F.broadcast(i), hit, "left")
    best = j.groupBy("tenant", "name", "access").agg(F.max_by(F.struct("local", "owner", "remote"), F.length("local")).alias("m"))
    b = best.withColumn("remote", F.when(F.col("m").isNotNull(), F.concat(F.col("m.remote"), F.expr("substring(name, length(m.local) + 1)")))).withColumn("owner", F.col("m.owner"))
    e = exports.select(F.col("owner").alias("_o"), "prefix", F.col("access").alias("_a"), "audience")
    covers = (F.col("owner") == F.col("_o")) & ((F.col("remote") == F.col("prefix")) | F.col("remote").startswith(F.concat(F.col("prefix"), F.lit("."))))
    covers = covers & F.col("_a").isin("both") | covers & (F.col("_a") == F.col("access"))
    ok = b.join(F.broadcast(e), covers & ((F.col("audience") == "*") | (F.col("audience") == F.col("tenant"))), "left").groupBy("tenant", "name", "access", "owner", "remote").agg(F.max(F.col("prefix").isNotNull()).alias("_ok"))
    kind = F.when(F.col("owner").isNull(), "own").when(F.col("_ok"), "crossed").otherwise("denied")
    return ok.select("tenant", "name", "access", kind.alias("resolution"), F.when(kind == "crossed", F.concat("owner", F.lit("/"), "remote")).alias("scoped"))


def has_scope(granted: Column, scope: str) -> Column:
    """Scopes do not imply one another."""
    return F.array_contains(granted, scope)


def manifest(files: DataFrame) -> DataFrame:
    """Checksum and size of each file of a ``binaryFile`` frame, for a backup to be held against."""
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.crc32("content").alias("crc32"), "length")


def restore_faults(files: DataFrame, listed: DataFrame) -> DataFrame:
    """What keeps a backup from being restored: files that are missing, damaged, or not in its manifest.

    ``binaryFile`` does not list empty files, so they count on neither side.
    """
    f = manifest(files).withColumnsRenamed({"crc32": "_crc32", "length": "_length"})
    j = listed.join(f, "file", "full_outer")
    same = (F.col("crc32") == F.col("_crc32")) & (F.col("length") == F.col("_length"))
    fault = F.when(F.col("_crc32").isNull(), "missing").when(F.col("crc32").isNull(), "unlisted").when(~same, "damaged")
    return j.select("file", fault.alias("fault")).filter("fault is not null")
