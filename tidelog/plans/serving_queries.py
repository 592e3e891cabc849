"""What a log serves: addressed reads, gaps, polls, leases and pauses, dead letters, names and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import names
from tidelog.operators import ordered, panels, reads, serving
from tidelog.plans.registry import query
from tidelog.sources.views import DAY_MS, NOW_MS, SQL, records, table

REC = "WITH " + SQL["rec"]
LOG_KEYS = 'stream, "partition"'
MAGIC = b"DEAD"


@query(
    "flushed_prefix",
    f"""{REC}, f AS (SELECT {LOG_KEYS}, (min("offset") + max("offset")) // 2 AS flushed FROM rec GROUP BY 1, 2)
    SELECT {LOG_KEYS}, "offset", key FROM rec JOIN f USING ({LOG_KEYS}) WHERE "offset" < flushed""",
)
def _(spark, d):
    r = records(spark, d)
    marks = r.groupBy(*serving.LOG).agg(F.expr("(min(offset) + max(offset)) div 2").alias("flushed"))
    return serving.flushed(r, marks).select(*serving.LOG, "offset", "key")


@query(
    "addressed_reads",
    f"""{REC}, q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ev-click' WHEN 1 THEN 'ev-view' ELSE 'ev-nothing' END AS stream, (c_custkey % 6)::INT AS "partition", c_custkey * 7 AS start FROM customer),
    n AS (SELECT stream, max("partition") + 1 AS partitions FROM rec GROUP BY 1), h AS (SELECT {LOG_KEYS}, max("offset") + 1 AS head FROM rec GROUP BY 1, 2),
    j AS (SELECT q.*, head, CASE WHEN partitions IS NULL THEN 'unknown_stream' WHEN "partition" >= partitions THEN 'partition_out_of_range' ELSE 'ok' END AS status FROM q LEFT JOIN n USING (stream) LEFT JOIN h USING ({LOG_KEYS}))
    SELECT c_custkey, stream, "partition", start, status, CASE WHEN status = 'ok' THEN greatest(coalesce(head, 0) - start, 0) END AS remaining FROM j""",
)
def _(spark, d):
    r, k = records(spark, d), F.col("c_custkey")
    stream = F.when(k % 3 == 0, "ev-click").when(k % 3 == 1, "ev-view").otherwise("ev-nothing")
    asked = table(spark, d, "customer").select(k, stream.alias("stream"), (k % 6).cast("int").alias("partition"), (k * 7).alias("start"))
    catalog = r.groupBy("stream").agg((F.max("partition") + 1).alias("partitions"))
    heads = r.groupBy(*serving.LOG).agg((F.max("offset") + 1).alias("head"))
    return serving.addressed(asked, catalog, heads)


CURSOR_SQL = f"""{REC}, b AS (SELECT {LOG_KEYS}, min("offset") + 100 AS earliest, max("offset") + 1 AS head, min("offset") AS low FROM rec GROUP BY 1, 2),
    c AS (SELECT {LOG_KEYS}, 'g' || k AS "group", CASE k WHEN 3 THEN head ELSE low + 60 * k END AS cursor FROM b, (SELECT unnest([0, 1, 2, 3, 4]) AS k))"""


def _cursors(spark, d):
    b = records(spark, d).groupBy(*serving.LOG).agg((F.min("offset") + 100).alias("earliest"), (F.max("offset") + 1).alias("head"), F.min("offset").alias("low"))
    k = F.col("k")
    c = b.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    c = c.select(*serving.LOG, F.concat(F.lit("g"), k.cast("string")).alias("group"), F.when(k == 3, F.col("head")).otherwise(F.col("low") + 60 * k).alias("cursor"))
    return c, b.drop("low")


@query("trimmed_gaps", CURSOR_SQL + f' SELECT {LOG_KEYS}, "group", cursor AS "from", earliest AS "to", 1 AS reason FROM c JOIN b USING ({LOG_KEYS}) WHERE cursor < earliest')
def _(spark, d):
    c, b = _cursors(spark, d)
    return serving.trimmed_gaps(c, b.drop("head"))


@query(
    "poll_outcomes",
    CURSOR_SQL
    + f""" SELECT {LOG_KEYS}, "group", CASE WHEN cursor < earliest THEN 'truncated' WHEN cursor >= head THEN 'idle' WHEN cursor % 4 > 2 THEN 'parked' ELSE 'message' END AS outcome,
    CASE WHEN cursor < earliest THEN earliest WHEN cursor < head THEN cursor END AS "offset", CASE WHEN cursor < earliest THEN earliest - cursor END AS skipped FROM c JOIN b USING ({LOG_KEYS})""",
)
def _(spark, d):
    c, b = _cursors(spark, d)
    return serving.poll(c.withColumn("deliveries", F.col("cursor") % 4), b, 2)


@query("stream_listing", REC + """ SELECT stream, (row_number() OVER (ORDER BY stream <> '', stream) - 1)::INT AS place FROM (SELECT stream FROM rec UNION SELECT '')""")
def _(spark, d):
    return serving.listing(records(spark, d))


EPOCH_SQL = f"""{REC}, ep AS (SELECT {LOG_KEYS}, segment_id + 1 AS epoch, min("offset") AS start_offset FROM rec GROUP BY {LOG_KEYS}, segment_id)"""


@query(
    "epoch_truncation",
    EPOCH_SQL
    + f""", cut AS (SELECT {LOG_KEYS}, (min("offset") + max("offset")) // 2 AS truncate_to FROM rec GROUP BY 1, 2)
    SELECT ep.* FROM ep JOIN cut USING ({LOG_KEYS}) WHERE start_offset < truncate_to""",
)
def _(spark, d):
    r = records(spark, d)
    epochs = r.groupBy(*serving.LOG, "segment_id").agg(F.min("offset").alias("start_offset")).select(*serving.LOG, (F.col("segment_id") + 1).alias("epoch"), "start_offset")
    cuts = r.groupBy(*serving.LOG).agg(F.expr("(min(offset) + max(offset)) div 2").alias("truncate_to"))
    return ordered.truncate_epochs(epochs, cuts)


@query("delivery_attempts", """SELECT event_id, event_type AS "group", user_id AS "offset", row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id)::INT AS attempt FROM events""")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("group"), F.col("user_id").alias("offset"))
    return serving.attempts(e, "event_id")


@query("distinct_devices", "SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) AS event_type FROM events")
def _(spark, d):
    return panels.distinct_counts(table(spark, d, "events"), "user_id", "event_type")


@query(
    "ack_states",
    """WITH a AS (SELECT event_type AS "group", event_id AS "offset" FROM events), k AS (SELECT event_type AS "group", user_id AS "offset" FROM events),
    u AS (SELECT DISTINCT "group", "offset" FROM k), i AS (SELECT *, "offset" - row_number() OVER (PARTITION BY "group" ORDER BY "offset") AS g FROM u),
    r AS (SELECT "group", min("offset") AS s, max("offset") + 1 AS e FROM i GROUP BY "group", g)
    SELECT a."group", a."offset", CASE WHEN r.s = 0 THEN 'committed' WHEN r.s IS NOT NULL THEN 'ahead' ELSE 'open' END AS state
    FROM a LEFT JOIN r ON a."group" = r."group" AND a."offset" >= r.s AND a."offset" < r.e""",
)
def _(spark, d):
    e = table(spark, d, "events")
    asked = e.select(F.col("event_type").alias("group"), F.col("event_id").alias("offset"))
    return serving.ack_state(asked, e.select(F.col("event_type").alias("group"), F.col("user_id").alias("offset")), width=32)


LEASE_SQL = f"""{REC}, l AS (SELECT stream AS "group", "offset", timestamp_ms AS granted, timestamp_ms + 30000 + ("offset" % 7) * 600000 AS deadline FROM rec),
    p AS (SELECT stream AS "group", min(timestamp_ms) + {DAY_MS} AS a, min(timestamp_ms) + {2 * DAY_MS} AS z FROM rec GROUP BY 1),
    s AS (SELECT l."group", "offset", granted, deadline + CASE WHEN deadline > a AND granted < z THEN z - greatest(a, granted) ELSE 0 END AS deadline FROM l JOIN p USING ("group"))"""


def _leases(spark, d):
    r = records(spark, d)
    leases = r.select(F.col("stream").alias("group"), "offset", F.col("timestamp_ms").alias("granted"), (F.col("timestamp_ms") + 30_000 + (F.col("offset") % 7) * 600_000).alias("deadline"))
    low = F.min("timestamp_ms")
    pauses = r.groupBy(F.col("stream").alias("group")).agg((low + DAY_MS).alias("from"), (low + 2 * DAY_MS).alias("to"))
    return serving.paused_deadlines(leases, pauses)


@query("paused_deadlines", LEASE_SQL + " SELECT * FROM s")
def _(spark, d):
    return _leases(spark, d)


@query("expired_leases", LEASE_SQL + f' SELECT "group", count(*) AS expired, min("offset") AS first FROM s WHERE deadline <= {NOW_MS} GROUP BY 1')
def _(spark, d):
    return serving.expired(_leases(spark, d), NOW_MS).groupBy("group").agg(F.count(F.lit(1)).alias("expired"), F.min("offset").alias("first"))


@query("purge_stream", REC + """ SELECT stream, count(*) AS records, max("offset") + 1 AS head FROM rec WHERE stream <> 'ev-error' GROUP BY 1""")
def _(spark, d):
    left = serving.purge(records(spark, d), spark.createDataFrame([("ev-error",)], "stream string"))
    return left.groupBy("stream").agg(F.count(F.lit(1)).alias("records"), (F.max("offset") + 1).alias("head"))


@query(
    "dead_letter_prune",
    f"""{REC}, f AS (SELECT stream AS "group", (min("offset") + max("offset")) // 2 AS floor FROM rec WHERE stream <> 'ev-view' GROUP BY 1)
    SELECT stream AS "group", "offset" AS source_offset FROM rec LEFT JOIN f ON stream = "group" WHERE "offset" >= coalesce(floor, 0) AND stream <> 'ev-signup'""",
)
def _(spark, d):
    r = records(spark, d)
    entries = r.select(F.col("stream").alias("group"), F.col("offset").alias("source_offset"))
    floors = entries.filter("`group` <> 'ev-view'").groupBy("group").agg(F.expr("(min(source_offset) + max(source_offset)) div 2").alias("floor"))
    return serving.prune_dead_letters(entries, floors, spark.createDataFrame([("ev-signup",)], "`group` string"))


@query(
    "recovered_twice",
    """SELECT event_id, user_id, 1 AS surplus FROM events WHERE value > 50 UNION ALL SELECT event_id, user_id + 1, -1 FROM events WHERE value > 50""",
)
def _(spark, d):
    e = table(spark, d, "events")
    again = e.select("event_id", F.when(F.col("value") > 50, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"))
    return serving.changes(e.select("event_id", "user_id"), again).withColumn("surplus", F.col("surplus").cast("int"))


DENSE_SQL = f"""{REC}, dn AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY "offset") - 1 AS pos, CASE WHEN key = '' THEN '' ELSE right(key, 1) END AS key, payload, timestamp_ms FROM rec),
    ds AS (SELECT *, pos // 20 AS segment_id FROM dn),
    sg AS (SELECT stream, segment_id, min(pos) AS base, max(pos) + 1 AS e, segment_id % 7 = 6 AS compacted, max(segment_id) OVER (PARTITION BY stream) AS newest FROM ds GROUP BY stream, segment_id),
    cd AS (SELECT *, row_number() OVER w AS i, base <> lag(e, 1, base) OVER w AS torn FROM sg WHERE NOT compacted AND segment_id < newest WINDOW w AS (PARTITION BY stream ORDER BY base)),
    ch AS (SELECT *, sum(torn::INT) OVER (PARTITION BY stream ORDER BY base) AS holes FROM cd),
    rn AS (SELECT stream, segment_id FROM ch WHERE holes = 0 AND i <= 8 QUALIFY count(*) OVER (PARTITION BY stream) >= 2),
    rw AS (SELECT ds.*, max(pos) OVER (PARTITION BY stream, key) AS last FROM ds JOIN rn USING (stream, segment_id)),
    tl AS (SELECT stream, count(*) AS total, count(*) FILTER (key <> '' AND (pos <> last OR payload = '' AND timestamp_ms + {DAY_MS} < {NOW_MS})) AS dropped FROM rw GROUP BY 1)"""


@query("dirty_run", DENSE_SQL + " SELECT stream, segment_id, total, dropped FROM rn JOIN tl USING (stream) WHERE dropped * 1000 >= total * 500")
def _(spark, d):
    dense = reads.dense_positions(records(spark, d))
    r = dense.select("stream", F.col("position").cast("long").alias("offset"), F.expr("cast(position div 20 as bigint)").alias("segment_id"), F.when(F.col("key") == "", "").otherwise(F.expr("right(key, 1)")).alias("key"), "payload", "timestamp_ms")
    segments = r.groupBy("stream", "segment_id").agg(F.min("offset").alias("base"), (F.max("offset") + 1).alias("end")).withColumn("compacted", F.col("segment_id") % 7 == 6)
    return ordered.dirty_run(r, segments, ["stream"], NOW_MS, DAY_MS)


# metric samples: every event gives a reading, the greatest of a series stands
_KINDS = [*panels.GROUPS.values(), *panels.STREAMS.values(), *panels.LOSS.values(), *panels.CONNECTIONS.values()]
_LABELS = ["group"] * 4 + ["stream", "reason", "state"]
SAMPLE_SQL = f"""WITH x AS (SELECT event_id % 7 AS k, event_type || '-' || user_id AS l, max(event_id) AS sample FROM events GROUP BY 1, 2),
    m AS (SELECT ({_KINDS!r})[k + 1] AS metric, l, sample FROM x)"""


def _samples(spark, d):
    k = (F.col("event_id") % 7).cast("int")
    x = table(spark, d, "events").groupBy(k.alias("k"), F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("l")).agg(F.max("event_id").alias("sample"))
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
    return x.select(pick(_KINDS).alias("metric"), F.create_map(pick(_LABELS), F.col("l")).alias("labels"), "sample")


def _pivot(columns, label):
    picks = ", ".join(f"coalesce(max(sample) FILTER (metric = '{m}'), 0) AS \"{c}\"" for c, m in columns.items())
    among = ", ".join(f"'{m}'" for m in columns.values())
    return f'{SAMPLE_SQL} SELECT l AS "{label}", {picks} FROM m WHERE metric IN ({among}) GROUP BY 1'


@query("report_groups", _pivot(panels.GROUPS, "group"))
def _(spark, d):
    return panels.groups(_samples(spark, d))


@query("report_streams", _pivot(panels.STREAMS, "stream") + " HAVING l LIKE '%view%'")
def _(spark, d):
    return panels.streams(_samples(spark, d), "view")


@query("report_losses", _pivot(panels.LOSS, "reason") + " HAVING max(sample) > 0")
def _(spark, d):
    return panels.losses(_samples(spark, d))


@query("report_connections", _pivot(panels.CONNECTIONS, "state"))
def _(spark, d):
    return panels.connections(_samples(spark, d))


_GAUGES = [*panels.STORAGE.values(), *panels.RECOVERY.values()]
GAUGE_SQL = f"""WITH x AS (SELECT event_id % 15 AS k, max(event_id) AS sample FROM events GROUP BY 1), m AS (SELECT ({_GAUGES!r})[k + 1] AS metric, CASE k WHEN 2 THEN -1 WHEN 6 THEN 1 ELSE sample END AS sample FROM x)"""


def _gauges(spark, d):
    x = table(spark, d, "events").groupBy((F.col("event_id") % 15).cast("int").alias("k")).agg(F.max("event_id").alias("sample"))
    metric = F.element_at(F.array(*[F.lit(n) for n in _GAUGES]), F.col("k") + 1)
    return x.select(metric.alias("metric"), F.when(F.col("k") == 2, -1).when(F.col("k") == 6, 1).otherwise(F.col("sample")).alias("sample"))


def _row(columns):
    return ", ".join(f"coalesce(max(sample) FILTER (metric = '{m}'), 0) AS {c}" for c, m in columns.items())


@query(
    "report_storage",
    f"""{GAUGE_SQL}, r AS (SELECT {_row(panels.STORAGE)} FROM m)
    SELECT segments, durable_bytes, CASE WHEN disk_free >= 0 THEN disk_free END AS disk_free, CASE WHEN ram_headroom >= 0 THEN ram_headroom END AS ram_headroom, logical_written, physical_written,
    physical_written::DOUBLE / nullif(logical_written, 0) AS write_amp FROM r""",
)
def _(spark, d):
    return panels.storage(_gauges(spark, d))


@query("report_recovery", f"{GAUGE_SQL}, r AS (SELECT {_row(panels.RECOVERY)} FROM m) SELECT * REPLACE (writer_healthy = 1 AS writer_healthy) FROM r")
def _(spark, d):
    return panels.recovery(_gauges(spark, d))


@query("head_and_committed_millions", f'{REC} SELECT stream, (max("offset") + 1) / 1e6 AS head, min("offset") / 1e6 AS committed FROM rec GROUP BY 1')
def _(spark, d):
    return records(spark, d).groupBy("stream").agg(serving.scaled(F.max("offset") + 1, 1e6).alias("head"), serving.scaled(F.min("offset"), 1e6).alias("committed"))


@query(
    "directory_bytes",
    f"""{REC} SELECT stream AS folder, count(DISTINCT segment_id) AS files, sum(octet_length(encode(payload)))::BIGINT AS bytes FROM rec GROUP BY 1""",
)
def _(spark, d):
    return records(spark, d).groupBy(F.col("stream").alias("folder")).agg(F.count_distinct("segment_id").alias("files"), F.sum(F.octet_length("payload")).alias("bytes"))


@query(
    "log_names",
    f"""{REC} SELECT "offset", 'seg-' || lpad(format('{{:x}}', "offset"), 16, '0') || '.log' AS segment, "offset"::DECIMAL(20, 0) AS segment_number, 'p-' || lpad(format('{{:x}}', "partition"), 8, '0') AS folder,
    CASE WHEN key = '' THEN 'cursor.ckpt' ELSE 'cursor-' || lower(hex(encode(key))) || '.ckpt' END AS cursor, key AS "group" FROM rec""",
)
def _(spark, d):
    r = records(spark, d).select("offset", names.segment_file(F.col("offset")).alias("segment"), names.partition_folder(F.col("partition")).alias("folder"), names.cursor_file(F.col("key")).alias("cursor"))
    return r.withColumns({"segment_number": names.number_in(F.col("segment"), names.SEGMENT_NAME), "group": names.group_of(F.col("cursor"))})


def _le(value, width):
    h = f"lpad(format('{{:X}}', {value}), {2 * width}, '0')"
    return " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(width)))


@query(
    "dead_letter_headers",
    f"""{REC} SELECT "offset", '{MAGIC.hex().upper()}' || {_le('"offset"', 8)} || {_le("user_id", 4)} || {_le("octet_length(encode(stream))", 2)} || {_le("octet_length(encode(payload))", 2)} || hex(encode(stream)) || hex(encode(payload)) AS packed,
    stream AS "group", "offset" AS source_offset, user_id AS attempt, payload AS headers FROM rec""",
)
def _(spark, d):
    packed = names.pack_dead_letter(MAGIC, F.col("stream"), F.col("offset"), F.col("user_id"), F.encode("payload", "utf-8"))
    r = records(spark, d).select("offset", packed.alias("p"))
    u = names.unpack_dead_letter(MAGIC, F.col("p"))
    return r.select("offset", F.hex("p").alias("packed"), u["group"].alias("group"), u["source_offset"].alias("source_offset"), u["attempt"].alias("attempt"), F.decode(u["headers"], "utf-8").alias("headers"))


@query(
    "payload_synthesis",
    """SELECT event_id, substr(event_id || ';' || repeat('sensor=edge temp=21.5 batt=98; ', 4), 1, 100) AS plain, substr(sha256(event_id || '-0') || sha256(event_id || '-1'), 1, 100) AS dense FROM events""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", names.compressible(F.col("event_id"), 100).alias("plain"), names.incompressible(F.col("event_id"), 100).alias("dense"))


@query("error_codes", "SELECT code, CASE WHEN code <> 'ERR_NOT_A_CODE' THEN starts_with(code, 'ERR_') END AS failure FROM (SELECT unnest(" + repr([*names.CODES, "ERR_NOT_A_CODE"]) + ") AS code)")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in [*names.CODES, "ERR_NOT_A_CODE"]], "code string").select("code", names.is_error(F.col("code")).alias("failure"))
