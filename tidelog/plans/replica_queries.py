"""Replication: quorum marks, read tiers, divergence, placement, mirrors, invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import replicas, tables
from tidelog.plans.registry import query
from tidelog.sources.views import SQL, records, table

REC = "WITH " + SQL["rec"]
#: Five replicas of each partition; replica 0 leads, replica k is behind by some records.
REPL_SQL = """repl AS (SELECT stream, "partition", k AS replica, k = 0 AS is_leader, max("offset") + 1 - k * k * 400 AS e FROM rec, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS k) GROUP BY 1, 2, 3)"""


def _replicas(spark, d):
    ends = records(spark, d).groupBy("stream", "partition").agg((F.max("offset") + 1).alias("top"))
    k = F.explode(F.array(*[F.lit(x).cast("long") for x in range(5)])).alias("replica")
    r = ends.select("stream", "partition", "top", k)
    return r.select("stream", "partition", "replica", (F.col("replica") == 0).alias("is_leader"), (F.col("top") - F.col("replica") * F.col("replica") * 400).alias("end"))


@query(
    "quorum_hw",
    f"""{REC}, {REPL_SQL}, s AS (SELECT r.*, max(e) FILTER (is_leader) OVER (PARTITION BY stream, "partition") AS lead FROM repl r),
    l AS (SELECT stream, "partition", list_sort(list(e) FILTER (is_leader OR lead - e <= 2000), 'DESC') AS x FROM s GROUP BY 1, 2)
    SELECT stream, "partition", x[2] AS high_watermark, len(x)::INT AS in_sync FROM l""",
)
def _(spark, d):
    return replicas.quorum_mark(_replicas(spark, d), ["stream", "partition"], 2, 2000)


@query(
    "follower_read_tier",
    f"""{REC}, f AS (SELECT "offset", ['committed', 'latest', 'leader'][user_id % 3 + 1] AS tier, "offset" AS a, "offset" + user_id % 5 * 100 - 50 AS b, CASE WHEN user_id % 7 = 0 THEN 0 ELSE least(5000, 4000 + user_id * 10) END AS safe FROM rec)
    SELECT "offset", safe, CASE WHEN b <= a THEN 'nothing' WHEN tier = 'committed' THEN CASE WHEN a < safe THEN 'serve_local' ELSE 'nothing' END
      WHEN tier = 'latest' AND a < safe THEN 'serve_local' ELSE 'confirm_with_leader' END AS decision FROM f""",
)
def _(spark, d):
    u, o = F.col("user_id"), F.col("offset")
    tier = F.element_at(F.array(F.lit("committed"), F.lit("latest"), F.lit("leader")), (u % 3 + 1).cast("int"))
    safe = replicas.safe_mark(F.lit(5000).cast("long"), F.when(u % 7 != 0, 4000 + u * 10))
    return records(spark, d).select("offset", safe.alias("safe"), replicas.read_decision(tier, o, o + u % 5 * 100 - 50, safe).alias("decision"))


COPY_SQL = """a AS (SELECT stream, "partition", "offset", md5(payload) AS mark FROM rec),
  b AS (SELECT stream, "partition", "offset", CASE WHEN "offset" % 1777 = 1700 THEN 'bad' ELSE md5(payload) END AS mark FROM rec WHERE "offset" % 2501 <> 2500)"""


def _copies(spark, d):
    r = records(spark, d).select("stream", "partition", "offset", F.md5(F.encode("payload", "utf-8")).alias("mark"))
    b = r.filter("offset % 2501 <> 2500").withColumn("mark", F.when(F.col("offset") % 1777 == 1700, "bad").otherwise(F.col("mark")))
    return r, b


@query("replica_divergence", f"""{REC}, {COPY_SQL} SELECT stream, "partition", min("offset") AS first_divergence FROM a FULL JOIN b USING (stream, "partition", "offset") WHERE a.mark IS DISTINCT FROM b.mark GROUP BY 1, 2""")
def _(spark, d):
    return replicas.first_divergence(*_copies(spark, d), ["stream", "partition"], whole=True)


@query(
    "divergence_heal",
    f"""{REC}, {COPY_SQL}, v AS (SELECT stream, "partition", min("offset") AS o FROM a JOIN b USING (stream, "partition", "offset") WHERE a.mark <> b.mark GROUP BY 1, 2), p AS (SELECT DISTINCT stream, "partition" FROM rec)
    SELECT p.stream, p."partition", o AS first_divergence, CASE WHEN o IS NULL THEN 'clean' WHEN o < 3000 THEN 'critical' ELSE 'heal_to_committed_floor' END AS action FROM p LEFT JOIN v USING (stream, "partition")""",
)
def _(spark, d):
    a, b = _copies(spark, d)
    v = replicas.first_divergence(a, b, ["stream", "partition"], whole=False)
    p = a.select("stream", "partition").distinct().join(v, ["stream", "partition"], "left")
    return p.select("stream", "partition", "first_divergence", replicas.heal(F.col("first_divergence"), F.lit(3000)).alias("action"))


@query("eligible_leaders", "SELECT n_nationkey AS node, n_nationkey * 37 % 100 AS durable_prefix FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey % 9 <> 5 AND n_nationkey * 37 % 100 >= 40")
def _(spark, d):
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(k.alias("node"), (k * 37 % 100).alias("durable_prefix"), (k % 4 != 1).alias("in_isr"), (k % 9 == 5).alias("divergent"))
    return replicas.eligible(r.withColumn("hw", F.lit(40)), "hw").select("node", "durable_prefix")


@query(
    "replica_spread",
    """WITH n AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 8 <> 3 THEN n_regionkey END AS "domain" FROM nation),
    r AS (SELECT *, row_number() OVER (PARTITION BY coalesce('d' || "domain", 'n' || node) ORDER BY node) AS k FROM n)
    SELECT node, "domain" FROM r ORDER BY k, "domain" IS NULL, "domain", node LIMIT 7""",
)
def _(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation").select(k.alias("node"), F.when(k % 8 != 3, F.col("n_regionkey")).alias("domain"))
    return replicas.spread(n, 7)


@query(
    "leader_balance",
    """WITH p AS (SELECT s_suppkey AS "partition", (s_nationkey + k) % 25 AS node FROM supplier, (SELECT unnest([0, 7, 13]) AS k)), l AS (SELECT n_nationkey AS node, n_nationkey * 7 % 5 AS load FROM nation),
    b AS (SELECT "partition", node FROM p LEFT JOIN l USING (node) QUALIFY row_number() OVER (PARTITION BY "partition" ORDER BY coalesce(load, 0), node) = 1)
    SELECT node AS leader, count(*) AS partitions FROM b GROUP BY node""",
)
def _(spark, d):
    k = F.explode(F.array(F.lit(0), F.lit(7), F.lit(13))).alias("k")
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("partition"), "s_nationkey", k).select("partition", ((F.col("s_nationkey") + F.col("k")) % 25).alias("node"))
    load = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") * 7 % 5).alias("load"))
    return replicas.leaders(p, load).groupBy("leader").agg(F.count(F.lit(1)).alias("partitions"))


@query(
    "mirror_apply",
    """WITH b AS (SELECT o_custkey % 5 AS s, o_orderkey FROM orders), n AS (SELECT 'm' || s AS stream, row_number() OVER (PARTITION BY s ORDER BY o_orderkey) - 1 AS i, o_orderkey FROM b),
    q AS (SELECT stream, i * 10 + CASE WHEN i >= 40 THEN 5 ELSE 0 END AS first_offset, 10::BIGINT AS n, CASE WHEN i = 60 THEN 4 ELSE 10 END::BIGINT AS valid FROM n),
    l AS (SELECT *, coalesce(lag(first_offset + n) OVER w, 0) = first_offset AND coalesce(lag(valid = n) OVER w, TRUE) AS good FROM q WINDOW w AS (PARTITION BY stream ORDER BY first_offset)),
    a AS (SELECT *, bool_and(good) OVER (PARTITION BY stream ORDER BY first_offset) AS accepted FROM l)
    SELECT stream, first_offset, accepted, CASE WHEN accepted THEN greatest(first_offset + valid - greatest(first_offset, 25), 0) ELSE 0 END AS appended FROM a""",
)
def _(spark, d):
    from pyspark.sql import Window as W

    s = F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string"))
    i = (F.row_number().over(W.partitionBy("stream").orderBy("o_orderkey")) - 1).cast("long")
    n = table(spark, d, "orders").select(s.alias("stream"), "o_orderkey").withColumn("i", i)
    b = n.select("stream", (F.col("i") * 10 + F.when(F.col("i") >= 40, 5).otherwise(0)).alias("first_offset"), F.lit(10).cast("long").alias("n"), F.when(F.col("i") == 60, 4).otherwise(10).cast("long").alias("valid"))
    return tables.mirror(b, 0, 25)


@query("acked_not_recovered", f"""{REC} SELECT "offset" FROM rec WHERE "offset" % 7 <> 3 AND "offset" % 2501 = 2500""")
def _(spark, d):
    a, b = _copies(spark, d)
    return a.filter("offset % 7 <> 3").join(b, ["stream", "partition", "offset"], "left_anti").select("offset")


@query("under_replicated_acks", """SELECT event_id AS "offset", event_id % 4 AS fsynced FROM events WHERE event_id % 4 < 2""")
def _(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("offset"), (F.col("event_id") % 4).alias("fsynced")).filter("fsynced < 2")


@query(
    "fan_in_offsets",
    """WITH u AS (SELECT c_mktsegment AS stream, c_custkey AS k, 0 AS o FROM customer UNION ALL SELECT c_mktsegment, c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0)
    SELECT stream, k, row_number() OVER (PARTITION BY stream ORDER BY k, o) - 1 AS "offset" FROM u""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("stream"), F.col("c_custkey").alias("k"))
    return tables.fan_in([c, c.filter("k % 3 = 0")], "k")
