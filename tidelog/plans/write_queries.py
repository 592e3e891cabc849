"""Appending, partitions, memory ceilings and command output."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import names
from tidelog.operators import writes
from tidelog.plans.registry import query
from tidelog.sources.views import SQL, records, table

REC = "WITH " + SQL["rec"]
LOG_KEYS = 'stream, "partition"'
APPEND_SQL = f"""{REC}, h AS (SELECT {LOG_KEYS}, count(*) AS head FROM rec WHERE stream <> 'ev-view' GROUP BY 1, 2),
    a AS (SELECT {LOG_KEYS}, "offset" AS seq, coalesce(head, 0) + row_number() OVER (PARTITION BY {LOG_KEYS} ORDER BY "offset") - 1 AS "offset" FROM rec LEFT JOIN h USING ({LOG_KEYS}))"""


def _append(spark, d):
    r = records(spark, d)
    heads = r.filter("stream <> 'ev-view'").groupBy(*writes.LOG).agg(F.count(F.lit(1)).alias("head"))
    return writes.append(r.select(*writes.LOG, F.col("offset").alias("seq")), heads, "seq"), heads


@query("dense_append", APPEND_SQL + " SELECT * FROM a")
def _(spark, d):
    return _append(spark, d)[0]


@query(
    "commit_outcomes",
    APPEND_SQL
    + f""", b AS (SELECT {LOG_KEYS}, "offset" + CASE WHEN stream = 'ev-error' THEN 1 ELSE 0 END AS "offset" FROM a WHERE stream <> 'ev-click'),
    g AS (SELECT {LOG_KEYS}, count(*) AS records, max("offset") AS last FROM b GROUP BY 1, 2)
    SELECT {LOG_KEYS}, CASE WHEN stream = 'ev-click' THEN 'unchanged' WHEN stream = 'ev-error' THEN 'rejected' ELSE 'committed' END AS outcome,
    CASE WHEN stream IN ('ev-click', 'ev-error') THEN 0 ELSE records END AS appended, CASE WHEN stream IN ('ev-click', 'ev-error') THEN head ELSE last + 1 END AS next_offset FROM h FULL JOIN g USING ({LOG_KEYS})""",
)
def _(spark, d):
    rows, heads = _append(spark, d)
    moved = rows.filter("stream <> 'ev-click'").withColumn("offset", F.col("offset") + F.when(F.col("stream") == "ev-error", 1).otherwise(0))
    return writes.commit_outcomes(moved, heads)


@query("keyless_partitions", """SELECT event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 3 % 8)::INT AS "partition" FROM events""")
def _(spark, d):
    return writes.spread(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], "event_id", 8, sticky=3).select("event_id", "partition")


@query("label_faults", """SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_type <> 'view' THEN 'subject_and_tag' END AS fault FROM events""")
def _(spark, d):
    subject = F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise("")
    tag = F.when(F.col("event_type") != "view", F.lit("t"))
    return table(spark, d, "events").select("event_id", writes.label_fault(subject, tag).alias("fault"))


@query(
    "memory_headroom",
    """WITH c AS (SELECT event_id, (event_id % 5) * 1000 AS ceiling, CASE WHEN event_type <> 'error' THEN user_id * 30 END AS used FROM events)
    SELECT event_id, CASE WHEN ceiling = 0 OR used IS NULL THEN -1 ELSE greatest(ceiling - used, 0) END AS headroom,
    CASE WHEN ceiling = 0 OR used IS NULL THEN -1 ELSE (greatest(ceiling - used, 0) * 1000 + ceiling // 2) // ceiling END AS permille, ceiling = 0 OR coalesce(used, 0) * 2 + 64 * event_id <= ceiling AS fits FROM c""",
)
def _(spark, d):
    c = table(spark, d, "events").select("event_id", ((F.col("event_id") % 5) * 1000).alias("ceiling"), F.when(F.col("event_type") != "error", F.col("user_id") * 30).alias("used"))
    ceiling, used = F.col("ceiling"), F.col("used")
    worst = [F.coalesce(used, F.lit(0)) * 2, F.col("event_id") * 64]
    return c.select("event_id", writes.headroom(ceiling, used).alias("headroom"), writes.headroom_permille(ceiling, used).alias("permille"), writes.fits(worst, ceiling).alias("fits"))


@query(
    "command_envelopes",
    f"""{REC} SELECT "offset", json_object('schema', 'cli.v1', 'ok', true, 'exit_code', 0, 'data', json_object('stdout', subject || chr(10) || payload || chr(10), 'lines', [subject, payload]))::VARCHAR AS done,
    json_object('schema', 'cli.v1', 'ok', false, 'exit_code', 2, 'error', json_object('kind', stream, 'message', payload))::VARCHAR AS failed FROM rec""",
)
def _(spark, d):
    text = F.concat("subject", F.lit("\n"), "payload", F.lit("\n"))
    failed = names.error_envelope("cli.v1", F.lit(2), F.col("stream"), F.col("payload"))
    return records(spark, d).select("offset", names.success_envelope("cli.v1", text).alias("done"), failed.alias("failed"))
