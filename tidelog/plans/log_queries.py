"""Routing, reads, and order of the log."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators import ordered, reads, routing
from tidelog.operators.reports import stream_summary
from tidelog.plans.registry import query
from tidelog.sources.views import DAY_MS, NOW_MS, SQL, records, table

REC = "WITH " + SQL["rec"]
BINDINGS = [("ev.click.u8", 1), ("ev.*.u8", 2), ("ev.click.*", 3), ("ev.>", 4), ("ev.error.>", 5), ("*.view.u1", 6), ("ev.view", 7), ("ops.>", 8), ("ev.*.*.x", 9)]
BIND_SQL = "bind AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {t})" for p, t in BINDINGS) + ") v(pattern, target))"
MATCH_SQL = (
    "hit AS (SELECT s.subject, b.pattern, b.target FROM (SELECT DISTINCT subject FROM rec) s JOIN bind b "
    "ON regexp_full_match(s.subject, replace(replace(replace(b.pattern, '.', '\\.'), '*', '[^.]+'), '>', '.+')))"
)


def _bindings(spark, rows=BINDINGS):
    return spark.createDataFrame(rows, "pattern string, target int")


@query("stream_summary", REC + ' SELECT stream, min("offset") AS earliest, max("offset") + 1 AS head, count(*) AS records FROM rec GROUP BY stream')
def _(spark, d):
    return stream_summary(records(spark, d))


@query("subject_route", f"{REC}, {BIND_SQL}, {MATCH_SQL} SELECT h.target, count(*) AS records FROM rec JOIN hit h USING (subject) GROUP BY h.target")
def _(spark, d):
    r = records(spark, d).select("subject")
    n = r.groupBy("subject").count()  # one row a subject before the join
    hit = routing.matches(r, _bindings(spark))
    return n.join(hit, "subject").groupBy("target").agg(F.sum("count").alias("records"))


HOME_ROWS = [("ev.click.u8", 1), ("ev.*.u8", 2), ("ev.view.*", 3), ("ev.error.>", 5)]


@query(
    "single_home_resolution",
    f"""{REC}, bind AS (SELECT * FROM (VALUES {", ".join(f"('{p}', {t})" for p, t in HOME_ROWS)}) v(pattern, target)), {MATCH_SQL},
    n AS (SELECT s.subject, count(h.target) AS n, min(h.target) AS home FROM (SELECT DISTINCT subject FROM rec) s LEFT JOIN hit h USING (subject) GROUP BY s.subject)
    SELECT subject, CASE WHEN n = 0 THEN 'no_stream' WHEN n = 1 THEN 'routed' ELSE 'ambiguous' END AS resolution, n, CASE WHEN n = 1 THEN home END AS home FROM n""",
)
def _(spark, d):
    return routing.single_home(records(spark, d), _bindings(spark, HOME_ROWS))


@query(
    "subject_validate",
    """WITH s AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'a..b' WHEN 2 THEN 'a.*.c' WHEN 3 THEN 'x.b*' WHEN 4 THEN 'a.>.b' WHEN 5 THEN 'a.b' || chr(9) || 'c'
      WHEN 6 THEN repeat('t.', 32) || 't' ELSE 'ev.' || event_type || '.u' || user_id END AS subject FROM events)
    SELECT event_id, subject, CASE event_id % 8 WHEN 0 THEN 'Empty' WHEN 1 THEN 'EmptyToken' WHEN 2 THEN 'WildcardNotAllowed' WHEN 3 THEN 'IllegalChar' WHEN 4 THEN 'WildcardNotAllowed'
      WHEN 5 THEN 'ControlChar' WHEN 6 THEN 'TooDeep' ELSE 'ok' END AS as_subject,
      CASE event_id % 8 WHEN 0 THEN 'Empty' WHEN 1 THEN 'EmptyToken' WHEN 2 THEN 'ok' WHEN 3 THEN 'IllegalChar' WHEN 4 THEN 'TailWildcardNotLast' WHEN 5 THEN 'ControlChar'
      WHEN 6 THEN 'TooDeep' ELSE 'ok' END AS as_pattern FROM s""",
)
def _(spark, d):
    k = F.col("event_id") % 8
    made = ["", "a..b", "a.*.c", "x.b*", "a.>.b", "a.b\tc", "t." * 32 + "t"]
    s = F.concat(F.lit("ev."), "event_type", F.lit(".u"), F.col("user_id").cast("string"))
    for i, x in enumerate(made):
        s = F.when(k == i, F.lit(x)).otherwise(s)
    e = table(spark, d, "events").select("event_id", s.alias("subject"))
    return e.select("event_id", "subject", routing.verdict(F.col("subject")).alias("as_subject"), routing.verdict(F.col("subject"), pattern=True).alias("as_pattern"))


@query(
    "filtered_gaps",
    f"""{REC}, k AS (SELECT *, subject LIKE 'ev.%.u1%' AS keep FROM rec),
    r AS (SELECT *, sum(keep::INT) OVER (PARTITION BY stream, "partition" ORDER BY "offset") AS run FROM k)
    SELECT stream, "partition", min("offset") AS "from", max("offset") + 1 AS "to", sum(octet_length(encode(payload)))::BIGINT AS bytes_skipped, count(*) AS records
    FROM r WHERE NOT keep GROUP BY stream, "partition", run""",
)
def _(spark, d):
    return reads.filtered_gaps(records(spark, d), F.col("subject").rlike(r"^ev\.[^.]+\.u1"))


@query(
    "offset_window",
    f"""{REC}, w AS (SELECT *, row_number() OVER p AS n, sum(octet_length(encode(payload))) OVER p AS b FROM rec WHERE "offset" >= 2000 WINDOW p AS (PARTITION BY stream, "partition" ORDER BY "offset"))
    SELECT stream, "partition", "offset", key FROM w WHERE n = 1 OR n <= 40 AND b <= 300""",
)
def _(spark, d):
    return reads.offset_window(records(spark, d), 2000, 40, 300).select("stream", "partition", "offset", "key")


@query(
    "seek_by_time",
    f"""{REC}, f AS (SELECT stream, "partition", min("offset") AS a FROM rec WHERE timestamp_ms >= {NOW_MS} GROUP BY 1, 2),
    r AS (SELECT rec.* FROM rec JOIN f USING (stream, "partition") WHERE "offset" >= a),
    t AS (SELECT stream, "partition", min("offset") AS b FROM r WHERE timestamp_ms >= {NOW_MS + DAY_MS} GROUP BY 1, 2)
    SELECT r.stream, r."partition", r."offset", r.timestamp_ms FROM r LEFT JOIN t USING (stream, "partition") WHERE b IS NULL OR "offset" < b""",
)
def _(spark, d):
    return reads.seek_by_time(records(spark, d), NOW_MS, NOW_MS + DAY_MS).select("stream", "partition", "offset", "timestamp_ms")


@query(
    "ttl_live",
    f"""{REC}, t AS (SELECT *, coalesce(least(nullif(ttl_ms, 0), {2 * DAY_MS}), 0) AS ttl FROM rec)
    SELECT stream, count(*) AS live, min("offset") AS first_live FROM t WHERE ttl = 0 OR timestamp_ms + ttl > {NOW_MS} GROUP BY stream""",
)
def _(spark, d):
    return reads.live(records(spark, d), NOW_MS, 2 * DAY_MS).groupBy("stream").agg(F.count(F.lit(1)).alias("live"), F.min("offset").alias("first_live"))


@query(
    "delay_gate",
    f"""{REC}, h AS (SELECT stream, "partition", min("offset") AS hold FROM rec WHERE due_ms > {NOW_MS} GROUP BY 1, 2)
    SELECT rec.stream, rec."partition", count(*) AS visible, max("offset") AS last_visible FROM rec LEFT JOIN h USING (stream, "partition") WHERE hold IS NULL OR "offset" < hold GROUP BY 1, 2""",
)
def _(spark, d):
    return reads.due_prefix(records(spark, d), NOW_MS).groupBy("stream", "partition").agg(F.count(F.lit(1)).alias("visible"), F.max("offset").alias("last_visible"))


@query(
    "truncate_notice",
    f"""{REC}, e AS (SELECT stream, "partition", min("offset") + 500 AS earliest FROM rec GROUP BY 1, 2),
    c AS (SELECT stream, "partition", 'g' || (user_id % 3) AS "group", min("offset") + 300 * (user_id % 3) AS cur FROM rec GROUP BY stream, "partition", user_id % 3)
    SELECT c.stream, c."partition", c."group", greatest(cur, earliest) AS "from", greatest(earliest - cur, 0) AS skipped FROM c JOIN e USING (stream, "partition")""",
)
def _(spark, d):
    r = records(spark, d)
    e = r.groupBy("stream", "partition").agg((F.min("offset") + 500).alias("earliest"))
    c = r.groupBy("stream", "partition", (F.col("user_id") % 3).alias("g")).agg(F.min("offset").alias("m"))
    c = c.select("stream", "partition", F.concat(F.lit("g"), F.col("g").cast("string")).alias("group"), (F.col("m") + 300 * F.col("g")).alias("cursor"))
    return reads.truncated(c, e)


@query("demux_positions", REC + ' SELECT stream, "offset", row_number() OVER (PARTITION BY stream ORDER BY "offset") - 1 AS position FROM rec')
def _(spark, d):
    return reads.dense_positions(records(spark, d)).select("stream", "offset", F.col("position").cast("long").alias("position"))


@query(
    "partition_counts",
    f"""{REC}, p AS (SELECT CASE WHEN key = '' THEN "offset" % 8 ELSE ('0x' || substr(md5(key), 1, 8))::BIGINT % 8 END AS part FROM rec) SELECT part, count(*) AS records FROM p GROUP BY part""",
)
def _(spark, d):
    part = F.when(F.col("key") == "", F.col("offset") % 8).otherwise(routing.partition_of(F.col("key"), 8))
    return records(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("records"))


@query(
    "rendezvous_owner",
    f"""{REC}, m AS (SELECT unnest([1, 2, 3, 5, 8]) AS member), s AS (SELECT DISTINCT key FROM rec),
    h AS (SELECT key, member, ('0x' || substr(md5(member || '|' || key), 1, 8))::BIGINT AS score FROM s, m)
    SELECT key, member AS owner FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) = 1""",
)
def _(spark, d):
    members = spark.createDataFrame([(m,) for m in (1, 2, 3, 5, 8)], "member int")
    return routing.rendezvous(records(spark, d), members)


COMPACT_SQL = f"""{REC}, c AS (SELECT *, max("offset") OVER (PARTITION BY stream, "partition", key) AS last FROM rec),
  s AS (SELECT * FROM c WHERE key = '' OR "offset" = last AND NOT (payload = '' AND timestamp_ms + {DAY_MS} < {NOW_MS}))"""


@query("compaction_survivors", COMPACT_SQL + ' SELECT stream, "partition", "offset", key FROM s')
def _(spark, d):
    return ordered.compact(records(spark, d), NOW_MS, DAY_MS).select("stream", "partition", "offset", "key")


@query(
    "compaction_gaps",
    COMPACT_SQL
    + """, l AS (SELECT stream, "partition", "offset" + 1 AS "from", lead("offset") OVER (PARTITION BY stream, "partition" ORDER BY "offset") AS "to" FROM s)
  SELECT * FROM l WHERE "to" > "from" """,
)
def _(spark, d):
    return reads.sparse_gaps(ordered.compact(records(spark, d), NOW_MS, DAY_MS))


@query(
    "dirty_segments",
    f"""{REC}, c AS (SELECT *, max("offset") OVER (PARTITION BY stream, "partition", key) AS last FROM rec)
    SELECT stream, "partition", segment_id, count(*) AS total, count(*) FILTER (key <> '' AND "offset" <> last) AS dropped,
      count(*) FILTER (key <> '' AND "offset" <> last) * 1000 // count(*) AS dirty_permille FROM c GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return ordered.dirty_segments(records(spark, d))


ANCHOR_SQL = f"""{REC}, a AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(max(timestamp_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix_max
  FROM rec WINDOW w AS (PARTITION BY stream, "partition", segment_id ORDER BY "offset")), an AS (SELECT stream, "partition", segment_id, "offset", prefix_max FROM a WHERE i % 8 = 0)"""


@query("time_anchors", ANCHOR_SQL + " SELECT * FROM an")
def _(spark, d):
    return ordered.time_anchors(records(spark, d), 8)


@query(
    "anchor_seek",
    ANCHOR_SQL
    + f""", e AS (SELECT stream, "partition", segment_id, max("offset") + 1 AS e FROM rec GROUP BY 1, 2, 3),
  n AS (SELECT *, row_number() OVER (PARTITION BY stream, "partition", segment_id ORDER BY "offset") AS k FROM an),
  f AS (SELECT stream, "partition", segment_id, count(*) FILTER (prefix_max < {NOW_MS}) AS below FROM n GROUP BY 1, 2, 3)
  SELECT f.stream, f."partition", f.segment_id, x."offset" AS scan_from, coalesce(y."offset", e.e) AS scan_bound FROM f JOIN e USING (stream, "partition", segment_id)
  JOIN n x ON x.stream = f.stream AND x."partition" = f."partition" AND x.segment_id = f.segment_id AND x.k = greatest(below, 1)
  LEFT JOIN n y ON y.stream = f.stream AND y."partition" = f."partition" AND y.segment_id = f.segment_id AND y.k = greatest(below, 1) + 1""",
)
def _(spark, d):
    r = records(spark, d)
    ends = r.groupBy("stream", "partition", "segment_id").agg((F.max("offset") + 1).alias("end"))
    return ordered.seek_window(ordered.time_anchors(r, 8), ends, NOW_MS)


@query(
    "ack_cursor",
    f"""{REC}, a AS (SELECT DISTINCT 'g' || ("offset" % 3) AS "group", "offset" // 3 AS o FROM rec WHERE "offset" % 7 <> 3 OR "offset" < 90),
    g AS (SELECT *, o - row_number() OVER (PARTITION BY "group" ORDER BY o) AS k FROM a), i AS (SELECT "group", min(o) AS s, max(o) + 1 AS e FROM g GROUP BY "group", k)
    SELECT "group", coalesce(max(e) FILTER (s = 0), 0) AS committed, count(*) FILTER (s > 0) AS runs, coalesce(sum(e - s) FILTER (s > 0), 0)::BIGINT AS ahead FROM i GROUP BY "group" """,
)
def _(spark, d):
    r = records(spark, d).filter("offset % 7 <> 3 or offset < 90")
    acks = r.select(F.concat(F.lit("g"), (F.col("offset") % 3).cast("string")).alias("group"), F.expr("offset div 3").alias("offset"))
    c = reads.ack_cursor(acks)
    total = F.aggregate("ahead", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return c.select("group", "committed", F.size("ahead").cast("long").alias("runs"), total.alias("ahead"))


@query(
    "cumulative_commit",
    f"""{REC} SELECT stream, 'g' || (user_id % 3) AS "group", max("offset") + 1 AS committed, count(*) AS commits FROM rec GROUP BY stream, user_id % 3""",
)
def _(spark, d):
    r = records(spark, d)
    g = F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string"))
    return r.groupBy("stream", g.alias("group")).agg((F.max("offset") + 1).alias("committed"), F.count(F.lit(1)).alias("commits"))


@query(
    "retention_reap",
    f"""{REC}, s AS (SELECT stream, "partition", segment_id, count(*) AS records, sum(octet_length(encode(payload)))::BIGINT AS bytes, max(timestamp_ms) AS last_ms, max("offset") + 1 AS e FROM rec GROUP BY 1, 2, 3),
    f AS (SELECT stream, "partition", max("offset") * 3 // 4 AS committed FROM rec GROUP BY 1, 2),
    w AS (SELECT s.*, committed, sum(bytes) OVER n AS b, sum(records) OVER n AS r, max(segment_id) OVER (PARTITION BY stream, "partition") AS newest FROM s JOIN f USING (stream, "partition")
      WINDOW n AS (PARTITION BY stream, "partition" ORDER BY segment_id DESC)),
    g AS (SELECT *, bool_and((b > 2000 OR r > 300 OR last_ms + {10 * DAY_MS} < {NOW_MS}) AND segment_id < newest AND e <= committed) OVER (PARTITION BY stream, "partition" ORDER BY segment_id) AS go FROM w)
    SELECT stream, "partition", segment_id, records, bytes FROM g WHERE go""",
)
def _(spark, d):
    r = records(spark, d)
    s = r.groupBy("stream", "partition", "segment_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("payload")).alias("bytes"), F.max("timestamp_ms").alias("last_ms"), (F.max("offset") + 1).alias("end"))
    floors = r.groupBy("stream", "partition").agg(F.expr("max(offset) * 3 div 4").alias("committed"))
    return ordered.retention(s, floors, 2000, 300, 10 * DAY_MS, NOW_MS)


@query(
    "prefix_check",
    """WITH r AS (SELECT event_type AS stream, 0 AS "partition", event_id // 1000 AS segment_id, event_id AS "offset", event_id // 1000 * 1000 AS base,
      event_id % 1000 + CASE WHEN event_id % 777 = 776 THEN 1 ELSE 0 END AS seq FROM events WHERE event_id % 3001 <> 3000),
    w AS (SELECT *, base + row_number() OVER (PARTITION BY segment_id ORDER BY "offset") - 1 AS want FROM r)
    SELECT 'events' AS stream, segment_id, min("offset") AS first_bad FROM w WHERE "offset" <> want OR seq <> want - base GROUP BY segment_id""",
)
def _(spark, d):
    i = F.col("event_id")
    r = table(spark, d, "events").filter("event_id % 3001 <> 3000").select(
        F.lit("events").alias("stream"), F.lit(0).alias("partition"), F.expr("event_id div 1000").alias("segment_id"), i.alias("offset"), F.expr("event_id div 1000 * 1000").alias("base"),
        (i % 1000 + F.when(i % 777 == 776, 1).otherwise(0)).alias("seq"),
    )
    return ordered.prefix_faults(r).select("stream", "segment_id", "first_bad")


EPOCH_SQL = """ep AS (SELECT stream, "partition", (min("offset") // 7 * 7) AS start_offset, segment_id + CASE WHEN segment_id = 5 THEN -3 ELSE 0 END AS epoch FROM rec GROUP BY stream, "partition", segment_id)"""


def _epochs(r):
    e = F.col("segment_id") + F.when(F.col("segment_id") == 5, -3).otherwise(0)
    return r.groupBy("stream", "partition", "segment_id").agg(F.expr("min(offset) div 7 * 7").alias("start_offset")).select("stream", "partition", "start_offset", e.alias("epoch"))


@query(
    "epoch_asof",
    f"""{REC}, {EPOCH_SQL} SELECT r.stream, e.epoch, count(*) AS records FROM rec r ASOF LEFT JOIN ep e ON r.stream = e.stream AND r."partition" = e."partition" AND r."offset" >= e.start_offset GROUP BY 1, 2""",
)
def _(spark, d):
    r = records(spark, d)
    return ordered.epoch_at(r, _epochs(r)).groupBy("stream", "epoch").agg(F.count(F.lit(1)).alias("records"))


@query(
    "epoch_monotonic",
    f"""{REC}, {EPOCH_SQL}, l AS (SELECT *, lag(epoch) OVER (PARTITION BY stream, "partition" ORDER BY start_offset) AS previous FROM ep) SELECT * FROM l WHERE previous > epoch""",
)
def _(spark, d):
    return ordered.epoch_regressions(_epochs(records(spark, d)))


@query(
    "divergence_point",
    f"""{REC}, l AS (SELECT stream, "partition", segment_id AS epoch, min("offset") AS s, max(max("offset") + 1) OVER (PARTITION BY stream, "partition") AS log_end FROM rec GROUP BY 1, 2, 3),
    f AS (SELECT stream, "partition", CASE WHEN epoch >= 6 THEN epoch + 100 ELSE epoch END AS epoch, s + (epoch % 2) * 3 AS s, log_end - 5 AS log_end FROM l),
    le AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY stream, "partition" ORDER BY epoch), log_end) AS e FROM l), fe AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY stream, "partition" ORDER BY epoch), log_end) AS e FROM f)
    SELECT stream, "partition", least(fe.e, le.e) AS truncate_to, fe.epoch AS diverged_at_epoch FROM fe JOIN le USING (stream, "partition", epoch) QUALIFY row_number() OVER (PARTITION BY stream, "partition" ORDER BY fe.epoch DESC) = 1""",
)
def _(spark, d):
    r = records(spark, d)
    seg = r.groupBy("stream", "partition", "segment_id").agg(F.min("offset").alias("s"), (F.max("offset") + 1).alias("e"))
    seg = seg.withColumn("log_end", F.max("e").over(W.partitionBy("stream", "partition")))
    leader = seg.select("stream", "partition", F.col("segment_id").alias("epoch"), F.col("s").alias("start_offset"), "log_end")
    k = F.col("segment_id")
    follower = seg.select("stream", "partition", F.when(k >= 6, k + 100).otherwise(k).alias("epoch"), (F.col("s") + (k % 2) * 3).alias("start_offset"), (F.col("log_end") - 5).alias("log_end"))
    return ordered.divergence_points(follower, leader)


@query(
    "nack_backoff",
    """SELECT event_id, 1 + user_id % 7 AS attempt, CASE WHEN event_id % 9 = 0 THEN 777 ELSE [100, 500, 2000, 10000][least(1 + user_id % 7, 4)] END::BIGINT AS delay_ms,
    CASE WHEN 1 + user_id % 7 > 5 THEN 'dead_letter' ELSE 'deliver' END AS disposition FROM events""",
)
def _(spark, d):
    a = 1 + F.col("user_id") % 7
    explicit = F.when(F.col("event_id") % 9 == 0, F.lit(777).cast("long"))
    return table(spark, d, "events").select("event_id", a.alias("attempt"), ordered.nack_backoff(a, [100, 500, 2000, 10_000], explicit).alias("delay_ms"), ordered.disposition(a, 5).alias("disposition"))


@query("fuzzy_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(lower(c_mktsegment), '(?s).*h.*d.*')")
def _(spark, d):
    return table(spark, d, "customer").filter(routing.fuzzy("HD", F.col("c_mktsegment"))).select("c_custkey", "c_mktsegment")


@query(
    "priority_drain",
    f"""{REC} SELECT "offset", least(user_id % 6, 3) AS lane, row_number() OVER (PARTITION BY stream, "partition" ORDER BY least(user_id % 6, 3) DESC, "offset") AS turn FROM rec""",
)
def _(spark, d):
    lane = F.least(F.col("user_id") % 6, F.lit(3))
    return ordered.drain_turns(records(spark, d).withColumn("lane", lane), "lane").select("offset", "lane", "turn")
