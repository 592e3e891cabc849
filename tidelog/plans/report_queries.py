"""Summaries, lags, losses, latencies, dead letters, transactions, sink checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import text as tf
from tidelog.operators import reports, tables
from tidelog.operators.ordered import disposition
from tidelog.plans.registry import query
from tidelog.schema import LOSS_REASONS
from tidelog.sources.views import NOW_MS, SQL, records, table

REC = "WITH " + SQL["rec"]


@query(
    "group_lag",
    f"""{REC}, h AS (SELECT stream, min("offset") AS earliest, max("offset") + 1 AS head FROM rec GROUP BY stream),
    c AS (SELECT stream, 'g' || (user_id % 5) AS "group", max("offset") * (user_id % 5) // 3 AS committed FROM rec GROUP BY stream, user_id % 5)
    SELECT c.stream, c."group", committed, greatest(head - committed, 0) AS lag, committed >= earliest AND committed <= head AS in_range FROM c JOIN h USING (stream)""",
)
def _(spark, d):
    r = records(spark, d)
    c = r.groupBy("stream", (F.col("user_id") % 5).alias("g")).agg(F.max("offset").alias("m"))
    c = c.select("stream", F.concat(F.lit("g"), F.col("g").cast("string")).alias("group"), F.expr("m * g div 3").alias("committed"))
    return reports.group_lag(c, reports.stream_summary(r).drop("records"))


@query(
    "lag_overflow",
    """WITH p AS (SELECT user_id, min(event_id) AS first_seen, count(*) AS lag FROM events GROUP BY user_id), t AS (SELECT user_id FROM p ORDER BY first_seen, user_id LIMIT 40)
    SELECT CASE WHEN t.user_id IS NULL THEN '__overflow__' ELSE p.user_id::VARCHAR END AS user_id, sum(lag)::BIGINT AS lag FROM p LEFT JOIN t USING (user_id) GROUP BY 1""",
)
def _(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_seen"), F.count(F.lit(1)).alias("lag"))
    return reports.fold_overflow(per, "user_id", "first_seen", "lag", 40, "__overflow__")


@query("throughput", f"""{REC} SELECT stream, "partition", count(*) AS produced, count(*) FILTER ("offset" % 7 <> 3) AS consumed, sum(octet_length(encode(payload)))::BIGINT AS bytes FROM rec GROUP BY ROLLUP (stream, "partition")""")
def _(spark, d):
    return records(spark, d).rollup("stream", "partition").agg(F.count(F.lit(1)).alias("produced"), F.count_if(F.col("offset") % 7 != 3).alias("consumed"), F.sum(F.octet_length("payload")).alias("bytes"))


@query(
    "consumer_counters",
    f"""{REC}, s AS (SELECT stream, CASE WHEN "offset" % 17 = 0 THEN 'dead_lettered' WHEN "offset" % 5 = 0 THEN 'filtered' WHEN "offset" % 3 = 0 THEN 'acked' ELSE 'delivered' END AS k FROM rec)
    SELECT stream, count(*) FILTER (k = 'delivered') AS delivered, count(*) FILTER (k = 'acked') AS acked, count(*) FILTER (k = 'dead_lettered') AS dead_lettered, count(*) FILTER (k = 'filtered') AS filtered FROM s GROUP BY stream""",
)
def _(spark, d):
    o = F.col("offset")
    k = F.when(o % 17 == 0, "dead_lettered").when(o % 5 == 0, "filtered").when(o % 3 == 0, "acked").otherwise("delivered")
    return records(spark, d).withColumn("k", k).groupBy("stream").agg(*[F.count_if(F.col("k") == n).alias(n) for n in ("delivered", "acked", "dead_lettered", "filtered")])


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
HIST_SQL = f"""h AS (SELECT e.event_type, b.le, count(*) FILTER (e.value <= b.le) AS cumulative, count(*) AS "count", round(sum(e.value), 4) AS total
  FROM events e, (SELECT unnest([{", ".join(map(str, BOUNDS))}, 'inf'::DOUBLE]) AS le) b GROUP BY e.event_type, b.le)"""


@query("latency_histogram", f'WITH {HIST_SQL} SELECT event_type, le::VARCHAR AS le, cumulative, "count", total FROM h')
def _(spark, d):
    h = reports.histogram(table(spark, d, "events"), ["event_type"], F.col("value"), BOUNDS)
    return h.select("event_type", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"), "cumulative", "count", F.round("total", 4).alias("total"))


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999, max(value) AS max FROM events GROUP BY event_type")
def _(spark, d):
    return reports.percentiles(table(spark, d, "events"), ["event_type"], "value")


LOSS_SQL = "loss AS (SELECT event_id, (event_id % 8 + 1)::INT AS reason_code, user_id * 1000 + event_id % 97 AS bytes_skipped, event_id % 5 AS records_lost_estimate FROM events)"


def _losses(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", (i % 8 + 1).cast("int").alias("reason_code"), (F.col("user_id") * 1000 + i % 97).alias("bytes_skipped"), (i % 5).alias("records_lost_estimate"))


@query(
    "loss_report",
    f"""WITH {LOSS_SQL}, n AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in LOSS_REASONS.items())}) v(reason_code, reason)),
    s AS (SELECT reason_code, sum(bytes_skipped)::BIGINT AS bytes, sum(records_lost_estimate)::BIGINT AS records, count(*) AS events FROM loss GROUP BY 1)
    SELECT n.reason_code, reason, coalesce(bytes, 0) AS bytes, coalesce(records, 0) AS records, coalesce(events, 0) AS events, reason <> 'torn_tail' AS is_data_loss FROM n LEFT JOIN s USING (reason_code)""",
)
def _(spark, d):
    return reports.loss_report(_losses(spark, d))


@query(
    "loss_caps",
    f"""WITH {LOSS_SQL}, s AS (SELECT max(bytes_skipped) AS largest, sum(bytes_skipped)::BIGINT AS total FROM loss)
    SELECT largest, total, 5000000 // 100 AS cap, CASE WHEN largest > 67108864 THEN 'per_event' WHEN total > 5000000 // 100 THEN 'global' ELSE 'ok' END AS verdict FROM s""",
)
def _(spark, d):
    return reports.loss_caps(_losses(spark, d), F.expr("bigint(5000000) div 100"), 64 << 20)


DLQ_SQL = f"""{REC}, q AS (SELECT 'g' || (user_id % 3) AS "group", "offset" AS source_offset, 1 + (value::INT % 9) AS deliveries FROM rec)"""


@query("dlq_route", DLQ_SQL + """ SELECT "group", source_offset, deliveries, CASE WHEN deliveries > 5 THEN 'dead_letter' ELSE 'deliver' END AS disposition FROM q""")
def _(spark, d):
    return _deliveries(spark, d).select("group", "source_offset", "deliveries", disposition(F.col("deliveries"), 5).alias("disposition"))


def _deliveries(spark, d):
    g = F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string"))
    return records(spark, d).select(g.alias("group"), F.col("offset").alias("source_offset"), (1 + F.rint("value").cast("int") % 9).alias("deliveries"))


@query("dlq_summary", DLQ_SQL + ' SELECT "group", count(*) AS entries, max(deliveries) AS most, min(source_offset) AS first FROM q WHERE deliveries > 5 GROUP BY "group"')
def _(spark, d):
    return _deliveries(spark, d).filter("deliveries > 5").groupBy("group").agg(F.count(F.lit(1)).alias("entries"), F.max("deliveries").alias("most"), F.min("source_offset").alias("first"))


@query("dlq_append", DLQ_SQL + """ SELECT "group", source_offset FROM q WHERE deliveries > 5 AND ("group", source_offset) NOT IN (SELECT ("group", source_offset) FROM q WHERE deliveries = 7)""")
def _(spark, d):
    new = _deliveries(spark, d).filter("deliveries > 5").select("group", "source_offset")
    return tables.only_new(new, _deliveries(spark, d).filter("deliveries = 7"), ["group", "source_offset"])


@query(
    "dlq_redrive",
    DLQ_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY source_offset) - 1 AS pos FROM q WHERE deliveries > 5) SELECT "group", source_offset, pos FROM n WHERE pos >= 20""",
)
def _(spark, d):
    entries = _deliveries(spark, d).filter("deliveries > 5")
    marks = spark.createDataFrame([(f"g{k}", 20) for k in range(3)], "group string, redriven long")
    return tables.redrive(entries, marks).select("group", "source_offset", "pos")


@query(
    "txn_visibility",
    """WITH o AS (SELECT o_orderkey AS txn_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'commit' WHEN 'O' THEN 'rollback' END AS op FROM orders)
    SELECT coalesce(op, 'unresolved') AS state, count(*) AS messages, count(*) FILTER (op = 'commit') AS visible FROM o GROUP BY 1""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    half = o.select(F.col("o_orderkey").alias("txn_id"), "o_custkey")
    ops = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("txn_id"), F.when(F.col("o_orderstatus") == "F", "commit").otherwise("rollback").alias("op"), F.lit(0).alias("at"))
    t = tables.txn_state(half, ops)
    return t.groupBy(F.coalesce("op", F.lit("unresolved")).alias("state")).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("op") == "commit").alias("visible"))


@query(
    "back_check_due",
    """WITH e AS (SELECT o_orderkey AS txn_id, epoch_ms(o_orderdate) // 1000 + 30 + 15 * (o_custkey % 4) AS next_eligible, o_custkey % 4 AS attempts FROM orders WHERE o_orderstatus = 'P')
    SELECT txn_id, next_eligible, CASE WHEN attempts + 1 >= 4 THEN 'terminal_default' ELSE 'rescheduled' END AS outcome FROM e WHERE next_eligible <= 1000000000 ORDER BY next_eligible, txn_id LIMIT 256""",
)
def _(spark, d):
    at = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    k = F.col("o_custkey") % 4
    e = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("txn_id"), (at + 30 + 15 * k).alias("next_eligible"), k.alias("attempts"))
    return tables.back_checks(e, 1_000_000_000, 256, 4)


@query("sink_contiguity", """SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS rows, max(event_id) - min(event_id) + 1 = count(*) AS contiguous, count(*) = count(DISTINCT event_id) AS no_duplicates FROM events""")
def _(spark, d):
    return tables.contiguity(table(spark, d, "events").withColumnRenamed("event_id", "offset"))


@query("sink_idempotent_append", f"""{REC} SELECT stream, count(*) AS fresh, min("offset") AS first, max("offset") + 1 AS next_offset FROM rec WHERE "offset" >= 4000 GROUP BY stream""")
def _(spark, d):
    r = records(spark, d)
    return tables.fresh(r, 4000).groupBy("stream").agg(F.count(F.lit(1)).alias("fresh"), F.min("offset").alias("first"), (F.max("offset") + 1).alias("next_offset"))


RUN_SQL = """run AS (SELECT event_type AS device, epoch_ms(date_trunc('day', ts)) // 1000 AS unix_secs, count(*)::DOUBLE AS throughput, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999,
  extract(day FROM date_trunc('day', ts)) % 9 <> 4 AS warmup_ok FROM events GROUP BY 1, date_trunc('day', ts))"""
NOW_S = NOW_MS // 1000


def _runs(spark, d):
    e = table(spark, d, "events")
    p = F.percentile("value", F.array(F.lit(0.99), F.lit(0.999)))
    g = e.groupBy(F.col("event_type").alias("device"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("throughput"), p.alias("p"))
    return g.select("device", (F.datediff("day", F.lit("1970-01-01").cast("date")) * 86_400).cast("long").alias("unix_secs"), "throughput", F.col("p")[0].alias("p99"), F.col("p")[1].alias("p999"), (F.dayofmonth("day") % 9 != 4).alias("warmup_ok"))


@query(
    "regression_gate",
    f"""WITH {RUN_SQL}, c AS (SELECT device, median(throughput) AS t, median(p99) AS p, median(p999) AS q FROM run WHERE warmup_ok AND unix_secs BETWEEN {NOW_S} - 604800 AND {NOW_S} GROUP BY device),
    b AS (SELECT device, median(throughput) AS t, median(p99) AS p, median(p999) AS q FROM run WHERE warmup_ok AND unix_secs < {NOW_S} - 604800 GROUP BY device),
    j AS (SELECT device, b.t > 0 AND (b.t - c.t) / b.t > 0.10 AS tb, b.p > 0 AND (c.p - b.p) / b.p > 0.15 AS pb, b.q > 0 AND (c.q - b.q) / b.q > 0.25 AS qb FROM c JOIN b USING (device))
    SELECT device, tb AS throughput_breach, pb AS p99_breach, qb AS p999_breach, CASE WHEN tb OR pb OR qb THEN 'fail' ELSE 'pass' END AS outcome FROM j""",
)
def _(spark, d):
    runs = _runs(spark, d)
    return reports.regression_gate(runs, runs.filter(F.col("unix_secs") < NOW_S - 604_800), NOW_S)


@query(
    "regression_outcome",
    f"""WITH {RUN_SQL}, c AS (SELECT device, median(throughput) AS t, median(p99) AS p, median(p999) AS q FROM run WHERE warmup_ok AND unix_secs BETWEEN {NOW_S} - 604800 AND {NOW_S} GROUP BY device),
    b AS (SELECT device, median(throughput) AS t, median(p99) AS p, median(p999) AS q FROM run WHERE warmup_ok AND unix_secs < {NOW_S} - 604800 GROUP BY device),
    n AS (SELECT count(*) FILTER (b.t > 0 AND (b.t - c.t) / b.t > 0.10 OR b.p > 0 AND (c.p - b.p) / b.p > 0.15 OR b.q > 0 AND (c.q - b.q) / b.q > 0.25) AS broken FROM c JOIN b USING (device))
    SELECT CASE WHEN NOT EXISTS (SELECT * FROM run WHERE unix_secs < {NOW_S} - 604800) THEN 'no_baseline' WHEN NOT EXISTS (SELECT * FROM c) THEN 'insufficient_data' WHEN broken = 0 THEN 'pass' ELSE 'fail' END AS outcome, broken FROM n""",
)
def _(spark, d):
    runs = _runs(spark, d)
    return reports.gate_outcome(runs, runs.filter(F.col("unix_secs") < NOW_S - 604_800), NOW_S)


@query("bench_medians", f"WITH {RUN_SQL} SELECT device, round(median(throughput), 6) AS median, count(throughput) AS n FROM run GROUP BY device")
def _(spark, d):
    return reports.latest_then_median(_runs(spark, d), ["device"], ["unix_secs"], "unix_secs", "throughput")


@query("mean_stdev", f"WITH {RUN_SQL} SELECT device, round(avg(throughput), 6) AS mean, round(stddev_pop(throughput), 6) AS stdev FROM run GROUP BY device")
def _(spark, d):
    return _runs(spark, d).groupBy("device").agg(F.round(F.avg("throughput"), 6).alias("mean"), F.round(F.stddev_pop("throughput"), 6).alias("stdev"))


@query("littles_law", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE round(user_id * (value * 1000 / 1000000.0), 9) END AS occupancy FROM events")
def _(spark, d):
    rate = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double"))
    return table(spark, d, "events").select("event_id", F.round(reports.occupancy(rate, F.col("value") * 1000), 9).alias("occupancy"))


@query(
    "write_amplification",
    f"""{REC} SELECT stream, sum(octet_length(encode(payload)))::BIGINT AS payload, sum(36 + 8 + octet_length(encode(payload)) + octet_length(encode(key)))::BIGINT AS stored,
    round(sum(44 + octet_length(encode(payload)) + octet_length(encode(key)))::DOUBLE / nullif(sum(octet_length(encode(payload))), 0), 6) AS amplification FROM rec GROUP BY stream""",
)
def _(spark, d):
    size = F.octet_length("payload") + F.octet_length("key") + 44
    a = F.try_divide(F.sum(size).cast("double"), F.sum(F.octet_length("payload")))
    return records(spark, d).groupBy("stream").agg(F.sum(F.octet_length("payload")).alias("payload"), F.sum(size).alias("stored"), F.round(a, 6).alias("amplification"))


@query(
    "tenant_quota",
    f"""{REC}, u AS (SELECT 't' || (user_id % 4) AS tenant, stream, octet_length(encode(payload)) AS bytes FROM rec), s AS (SELECT tenant, count(DISTINCT stream) AS streams, sum(bytes)::BIGINT AS bytes FROM u GROUP BY tenant)
    SELECT tenant, streams, bytes, CASE tenant WHEN 't0' THEN streams > 3 WHEN 't1' THEN bytes > 1000 ELSE FALSE END AS over FROM s""",
)
def _(spark, d):
    u = records(spark, d).select(F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant"), "stream", F.octet_length("payload").alias("bytes"))
    q = spark.createDataFrame([("t0", 3, 0), ("t1", 0, 1000), ("t2", 0, 0), ("t3", 0, 10**15)], "tenant string, max_streams long, max_bytes long")
    return reports.quota(u, q)


@query("traceparent_parse", r"""WITH h AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '00-' || md5(event_id::VARCHAR) || '-' || substr(md5(user_id::VARCHAR), 1, 16) || '-01' WHEN 1 THEN 'x: y' || chr(10) || ' TraceParent : 00-' || md5(event_id::VARCHAR) || '-' || substr(md5(user_id::VARCHAR), 1, 16) || '-00'
    WHEN 2 THEN '00-' || repeat('0', 32) || '-' || substr(md5(user_id::VARCHAR), 1, 16) || '-01' WHEN 3 THEN '00-' || md5(event_id::VARCHAR) || '-' || substr(md5(user_id::VARCHAR), 1, 16) || '-01-x' ELSE 'none' END AS headers FROM events)
    SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN regexp_extract(headers, '00-([0-9a-f]{32})-', 1) END AS trace_id FROM h""")
def _(spark, d):
    i, tr, sp = F.col("event_id"), F.md5(F.encode(F.col("event_id").cast("string"), "utf-8")), F.substring(F.md5(F.encode(F.col("user_id").cast("string"), "utf-8")), 1, 16)
    h = (
        F.when(i % 5 == 0, F.concat(F.lit("00-"), tr, F.lit("-"), sp, F.lit("-01")))
        .when(i % 5 == 1, F.concat(F.lit("x: y\n TraceParent : 00-"), tr, F.lit("-"), sp, F.lit("-00")))
        .when(i % 5 == 2, F.concat(F.lit("00-" + "0" * 32 + "-"), sp, F.lit("-01")))
        .when(i % 5 == 3, F.concat(F.lit("00-"), tr, F.lit("-"), sp, F.lit("-01-x")))
        .otherwise("none")
    )
    return table(spark, d, "events").select("event_id", tf.traceparent(h)["trace_id"].alias("trace_id"))


@query(
    "parse_duration",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN user_id WHEN 1 THEN user_id * 1000 WHEN 2 THEN user_id * 60000 WHEN 3 THEN user_id * 3600000 WHEN 4 THEN user_id * 86400000 END AS ms,
    CASE event_id % 7 WHEN 5 THEN user_id * 1024 END AS bytes FROM events""",
)
def _(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ms", "s", "m", "h", "d", "KiB", "MB")]), (F.col("event_id") % 7 + 1).cast("int"))
    raw = F.concat(F.col("user_id").cast("string"), unit)
    return table(spark, d, "events").select("event_id", tf.duration_ms(raw).alias("ms"), tf.byte_size(raw).alias("bytes"))


KEYS = ["retention.max_bytes", "retention.max_age", "consumer.max_deliver", "consumer.visibility", "storage.segment_bytes"]


@query(
    "did_you_mean",
    f"""WITH k AS (SELECT unnest({KEYS!r}) AS key), q AS (SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN 'retention.max_byte' WHEN 1 THEN 'consumer.max_delivr' WHEN 2 THEN 'storage.segmentbytes' ELSE 'nothing.like.it' END AS asked FROM events),
    j AS (SELECT asked, key, levenshtein(asked, key) AS dist FROM q, k QUALIFY row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, key), key) = 1)
    SELECT asked, CASE WHEN dist <= greatest(length(asked) // 3, 2) THEN key END AS suggestion FROM j""",
)
def _(spark, d):
    i = F.col("event_id") % 4
    asked = F.when(i == 0, "retention.max_byte").when(i == 1, "consumer.max_delivr").when(i == 2, "storage.segmentbytes").otherwise("nothing.like.it")
    q = table(spark, d, "events").select(asked.alias("asked")).distinct()
    return q.select("asked", tf.did_you_mean(F.col("asked"), KEYS).alias("suggestion"))


@query("uptime_format", """SELECT user_id, CASE WHEN user_id * 5000 >= 86400 THEN (user_id * 5000 // 86400) || 'd ' ELSE '' END || CASE WHEN user_id * 5000 >= 3600 THEN (user_id * 5000 % 86400 // 3600) || 'h ' ELSE '' END
    || CASE WHEN user_id * 5000 >= 60 THEN (user_id * 5000 % 3600 // 60) || 'm ' ELSE '' END || (user_id * 5000 % 60) || 's' AS uptime FROM (SELECT DISTINCT user_id FROM events)""")
def _(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", tf.uptime(F.col("user_id") * 5000).alias("uptime"))


@query(
    "request_reply_join",
    """WITH q AS (SELECT event_id AS corr, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id - event_id % 3 AS corr, ts AS reply_ts, event_id FROM events WHERE event_type = 'view')
    SELECT q.corr, p.event_id AS reply FROM q LEFT JOIN p ON q.corr = p.corr AND reply_ts >= q.ts AND reply_ts < q.ts + INTERVAL 10 MINUTE""",
)
def _(spark, d):
    e = table(spark, d, "events")
    q = e.filter("event_type = 'click'").select(F.col("event_id").alias("corr"), F.col("ts").alias("at"))
    p = e.filter("event_type = 'view'").select((F.col("event_id") - F.col("event_id") % 3).alias("corr"), F.col("ts").alias("at"), F.col("event_id").alias("reply"))
    return tables.correlate(q, p, "corr", "10 minutes").select("corr", "reply")


@query(
    "confirm_join",
    f"""{REC}, c AS (SELECT stream, max("offset") * 2 // 3 AS committed FROM rec GROUP BY stream)
    SELECT stream, CASE WHEN "offset" < committed THEN 'consumed' WHEN {NOW_MS} - timestamp_ms >= 300000 THEN 'timed_out' ELSE 'pending' END AS outcome, count(*) AS n FROM rec JOIN c USING (stream) GROUP BY 1, 2""",
)
def _(spark, d):
    r = records(spark, d)
    c = r.groupBy("stream").agg(F.expr("max(offset) * 2 div 3").alias("committed"))
    return tables.confirmations(r, c, NOW_MS, 300_000).groupBy("stream", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "connection_rejects",
    "SELECT event_type AS reason, count(*) AS n FROM events GROUP BY event_type",
)
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "comparable_pairs",
    """WITH b AS (SELECT s_suppkey, s_nationkey % 3 AS durability, s_nationkey % 2 AS size, s_nationkey % 5 AS device FROM supplier)
    SELECT x.s_suppkey AS "left", y.s_suppkey AS "right" FROM b x JOIN b y USING (durability, size, device) WHERE x.s_suppkey < y.s_suppkey""",
)
def _(spark, d):
    n = F.col("s_nationkey")
    b = table(spark, d, "supplier").select("s_suppkey", (n % 3).alias("durability"), (n % 2).alias("size"), (n % 5).alias("device"))
    x, y = b.withColumnRenamed("s_suppkey", "left"), b.withColumnRenamed("s_suppkey", "right")
    return x.join(y, ["durability", "size", "device"]).filter("left < right").select("left", "right")


