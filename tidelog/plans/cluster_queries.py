"""Acknowledgement levels, leadership, federation and forwarding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import cluster, folds
from tidelog.plans.registry import query
from tidelog.sources.views import SQL, records, table

REC = "WITH " + SQL["rec"]


@query(
    "cluster_ack_levels",
    """WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'c0' WHEN 1 THEN 'c1' WHEN 2 THEN 'c2-pagecache' WHEN 3 THEN 'c2-fsync' WHEN 4 THEN 'c3' END AS asked, 1 + user_id % 5 AS replicas, value > 50 AS opted FROM events)
    SELECT event_id, CASE WHEN asked IS NULL THEN CASE WHEN replicas >= 3 THEN 'c2-fsync' ELSE 'c1' END WHEN asked = 'c3' THEN NULL WHEN asked = 'c2-pagecache' AND NOT opted THEN 'c2-fsync' ELSE asked END AS level FROM a""",
)
def _(spark, d):
    k = F.col("event_id") % 6
    asked = F.when(k == 4, "c3")
    for i, level in enumerate(cluster.ACK_LEVELS):
        asked = F.when(k == i, level).otherwise(asked)
    return table(spark, d, "events").select("event_id", cluster.resolve_level(asked, 1 + F.col("user_id") % 5, F.col("value") > 50).alias("level"))


@query("fsync_headroom", """SELECT event_id, (event_id % 9) = 0 OR (event_id % 9) * 100 + user_id <= 600 AS admitted FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", cluster.admits((F.col("event_id") % 9) * 100, F.col("user_id"), 600).alias("admitted"))


@query(
    "quorum_ack_release",
    f"""{REC}, p AS (SELECT stream, "partition", "offset" AS seq, "offset" - CASE WHEN "offset" % 10 = 9 THEN 9 ELSE 0 END AS "offset" FROM rec),
    c AS (SELECT stream, "partition", CASE WHEN stream <> 'ev-view' THEN (min("offset") + max("offset")) // 2 END AS commit FROM rec GROUP BY 1, 2),
    w AS (SELECT p.*, bool_and(coalesce(p."offset" < commit, false)) OVER (PARTITION BY stream, "partition" ORDER BY seq) AS released FROM p JOIN c USING (stream, "partition"))
    SELECT stream, "partition", seq, "offset", released FROM w""",
)
def _(spark, d):
    r, o = records(spark, d), F.col("offset")
    parked = r.select("stream", "partition", o.alias("seq"), (o - F.when(o % 10 == 9, 9).otherwise(0)).alias("offset"))
    commits = r.groupBy("stream", "partition").agg(F.expr("(min(offset) + max(offset)) div 2").alias("commit"))
    return cluster.release_acks(parked, commits.withColumn("commit", F.when(F.col("stream") != "ev-view", F.col("commit"))))


SEEN_SQL = """WITH s AS (SELECT event_type AS node, event_id AS n, event_id // 40 - CASE WHEN event_id % 9 = 8 THEN 3 ELSE 0 END AS term, user_id % 3 <> 0 AS leads, event_id * 10 AS now FROM events),
    e AS (SELECT *, coalesce(max(term) OVER (PARTITION BY node ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM s),
    l AS (SELECT *, max(CASE WHEN term >= held THEN n END) OVER (PARTITION BY node ORDER BY n) AS taken FROM e),
    v AS (SELECT l.node, l.n, CASE WHEN l.term > l.held THEN 'advanced' WHEN l.term = l.held THEN 'unchanged' ELSE 'stale' END AS outcome, greatest(l.term, l.held) AS epoch,
      CASE WHEN t.leads THEN t.now + 500 END AS deadline, l.now FROM l LEFT JOIN s t ON l.node = t.node AND l.taken = t.n)"""


def _seen(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(
        F.col("event_type").alias("node"), F.expr("event_id div 1000").alias("segment"), i.alias("n"), (F.expr("event_id div 40") - F.when(i % 9 == 8, 3).otherwise(0)).alias("term"),
        (F.col("user_id") % 3 != 0).alias("leads"), (i * 10).alias("now"),
    )
    return cluster.leadership(e, 500)


@query("leadership", SEEN_SQL + " SELECT node, n, outcome, epoch, deadline FROM v")
def _(spark, d):
    return _seen(spark, d).select("node", "n", "outcome", "epoch", "deadline")


@query("leader_fencing", SEEN_SQL + " SELECT node, n, (n // 40 <> epoch) OR deadline IS NULL OR now + 400 >= deadline AS refused FROM v")
def _(spark, d):
    v = _seen(spark, d)
    return v.select("node", "n", cluster.fenced(F.expr("n div 40"), F.col("epoch"), F.col("deadline"), F.col("now") + 400).alias("refused"))


@query(
    "federation_roles",
    """SELECT 's' || s_suppkey AS local, 'd' || s_nationkey AS origin, 'up.' || s_suppkey AS remote, CASE WHEN s_nationkey = 3 THEN 'served' WHEN n_regionkey <> 2 THEN 'mirrored' ELSE 'unknown_peer' END AS role,
    CASE WHEN s_nationkey <> 3 AND n_regionkey <> 2 THEN n_name || ':4222' END AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, d):
    domain = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    key = F.col("s_suppkey").cast("string")
    streams = table(spark, d, "supplier").select(F.concat(F.lit("s"), key).alias("local"), domain("s_nationkey").alias("origin"), F.concat(F.lit("up."), key).alias("remote"))
    peers = table(spark, d, "nation").filter("n_regionkey <> 2").select(domain("n_nationkey").alias("origin"), F.concat("n_name", F.lit(":4222")).alias("address"))
    return cluster.federated(streams, peers, "d3")


@query(
    "leaf_push",
    """WITH RECURSIVE p AS (SELECT event_type AS leaf, event_id AS n, row_number() OVER w AS i, (row_number() OVER w) * 4 - 4 - 3 * (event_id % 3) AS start, 4 + event_id % 5 AS claimed, CASE WHEN user_id % 5 = 0 THEN 2 ELSE 4 + event_id % 5 END AS valid
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
    f AS (SELECT leaf, 0::BIGINT AS i, 0::BIGINT AS head, NULL::BIGINT AS n, '' AS verdict, 0::BIGINT AS appended, 0::BIGINT AS accepted_through FROM (SELECT DISTINCT leaf FROM p)
      UNION ALL
      SELECT p.leaf, p.i, f.head + CASE WHEN p.start + p.claimed <= f.head THEN 0 ELSE greatest(p.valid - greatest(f.head - p.start, 0), 0) END, p.n,
        CASE WHEN p.start + p.claimed <= f.head THEN 'known' WHEN p.valid >= p.claimed THEN 'accepted' ELSE 'corrupt' END,
        CASE WHEN p.start + p.claimed <= f.head THEN 0 ELSE greatest(p.valid - greatest(f.head - p.start, 0), 0) END,
        CASE WHEN p.start + p.claimed <= f.head OR p.valid >= p.claimed THEN p.start + p.claimed END
      FROM f JOIN p ON p.leaf = f.leaf AND p.i = f.i + 1)
    SELECT leaf, n, verdict, appended, accepted_through FROM f WHERE i > 0""",
)
def _(spark, d):
    from pyspark.sql import Window as W

    i, row = F.col("event_id"), F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))
    claimed = 4 + i % 5
    e = table(spark, d, "events").select(
        F.col("event_type").alias("leaf"), i.alias("n"), (row * 4 - 4 - 3 * (i % 3)).cast("long").alias("start"), claimed.alias("claimed"), F.when(F.col("user_id") % 5 == 0, 2).otherwise(claimed).cast("long").alias("valid"),
    )
    return folds.fold(e, ["leaf"], ["n"], ["start", "claimed", "valid"], cluster.leaf_machine, "leaf string, n long, verdict string, appended long, accepted_through long")
