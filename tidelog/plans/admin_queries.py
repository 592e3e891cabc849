"""Administration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import sampling
from tidelog.operators import admin
from tidelog.plans.registry import query
from tidelog.sources.views import SQL, records, table

REC = "WITH " + SQL["rec"]


@query(
    "cursor_reset",
    f"""{REC}, e AS (SELECT stream, min("offset") + 100 AS earliest, max("offset") + 1 AS head FROM rec GROUP BY stream)
    SELECT stream, kind, CASE kind WHEN 'earliest' THEN earliest WHEN 'latest' THEN head ELSE least(greatest(50, earliest), head) END AS committed FROM e, (SELECT unnest(['earliest', 'latest', 'offset']) AS kind)""",
)
def _(spark, d):
    e = records(spark, d).groupBy("stream").agg((F.min("offset") + 100).alias("earliest"), (F.max("offset") + 1).alias("head"))
    e = e.select("*", F.explode(F.array(F.lit("earliest"), F.lit("latest"), F.lit("offset"))).alias("kind"))
    return e.select("stream", "kind", admin.reset_target(F.col("kind"), F.lit(50).cast("long"), F.col("earliest"), F.col("head")).alias("committed"))


@query(
    "peek_json",
    f"""{REC}, k AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY "offset") AS n FROM rec)
    SELECT stream, "offset", '{{"stream":"' || stream || '","offset":' || "offset" || ',"key":"' || key || '","subject":"' || subject || '","payload":"' || replace(payload, '"', '\\"') || '"}}' AS line FROM k WHERE n <= 5""",
)
def _(spark, d):
    return admin.peek(records(spark, d), 5)


@query(
    "quarantine_cap",
    f"""{REC}, q AS (SELECT stream, "offset", octet_length(encode(payload)) AS size FROM rec), w AS (SELECT *, sum(size) OVER (PARTITION BY stream ORDER BY "offset" DESC) AS s FROM q) SELECT stream, "offset", size FROM w WHERE s <= 200""",
)
def _(spark, d):
    q = records(spark, d).select("stream", "offset", F.octet_length("payload").cast("long").alias("size"))
    return admin.newest_within(q, ["stream"], "offset", "size", 200)


@query(
    "produce_cap_gate",
    f"""{REC}, w AS (SELECT *, sum(octet_length(encode(payload))) OVER (PARTITION BY stream, "partition" ORDER BY "offset") AS used FROM rec)
    SELECT stream, "partition", count(*) FILTER (used <= 1500) AS admitted, count(*) FILTER (used > 1500) AS shed FROM w GROUP BY 1, 2""",
)
def _(spark, d):
    r = admin.admit_until_full(records(spark, d), 1500)
    return r.groupBy("stream", "partition").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("shed"))


@query(
    "lru_victims",
    f"""{REC}, l AS (SELECT stream, user_id, max("offset") AS last_touch FROM rec GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY last_touch DESC, user_id) AS r FROM l)
    SELECT stream, user_id, last_touch FROM r WHERE r > 100""",
)
def _(spark, d):
    return admin.least_recent(records(spark, d), "stream", "offset", "user_id", 100)


@query("ack_level_counts", """WITH f AS (SELECT (event_id % 32)::INT AS fl FROM events) SELECT CASE WHEN fl & 1 <> 0 THEN 'no_ack' WHEN (fl & 12) >> 2 = 1 THEN 'no_ack' WHEN (fl & 12) >> 2 = 2 THEN 'server_and_client_ack' ELSE 'server_ack' END AS level, count(*) AS n FROM f GROUP BY 1""")
def _(spark, d):
    f = (F.col("event_id") % 32).cast("int")
    return table(spark, d, "events").groupBy(admin.ack_level(f, 1, 12, 2).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("domain_refs", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd' || user_id WHEN 1 THEN 'd' || user_id END AS "domain", CASE event_id % 3 WHEN 0 THEN 'ev/' || event_type WHEN 1 THEN '' END AS stream FROM events""")
def _(spark, d):
    i, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    spec = F.when(i == 0, F.concat(F.lit("@d"), u, F.lit("/ev/"), "event_type")).when(i == 1, F.concat(F.lit("@d"), u)).otherwise(F.concat(F.lit("host:"), u))
    return table(spark, d, "events").select("event_id", admin.domain_ref(spec).alias("r")).select("event_id", "r.domain", "r.stream")


@query("unreachable_files", "SELECT 'f' || o_orderkey AS file FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"))
    return admin.unreachable(o, o.filter("o_orderkey % 3 = 0").unionByName(o.filter("o_orderkey % 5 = 0")))


@query(
    "tenant_sharing",
    """WITH a AS (SELECT DISTINCT 't' || (user_id % 3) AS tenant, CASE user_id % 5 WHEN 0 THEN 'partner' WHEN 1 THEN 'partner.orders' WHEN 2 THEN 'partnerize' WHEN 3 THEN 'partner.orders.eu' ELSE 'mine' END AS name, CASE WHEN user_id % 2 = 0 THEN 'read' ELSE 'write' END AS access FROM events),
    b AS (SELECT *, CASE WHEN tenant = 't0' AND (name = 'partner' OR starts_with(name, 'partner.')) THEN 'out' || substr(name, 8) END AS remote FROM a)
    SELECT tenant, name, access, CASE WHEN remote IS NULL THEN 'own' WHEN access = 'read' AND (remote = 'out.orders' OR starts_with(remote, 'out.orders.')) THEN 'crossed' ELSE 'denied' END AS resolution,
    CASE WHEN remote IS NOT NULL AND access = 'read' AND (remote = 'out.orders' OR starts_with(remote, 'out.orders.')) THEN 't9/' || remote END AS scoped FROM b""",
)
def _(spark, d):
    u = F.col("user_id")
    name = F.when(u % 5 == 0, "partner").when(u % 5 == 1, "partner.orders").when(u % 5 == 2, "partnerize").when(u % 5 == 3, "partner.orders.eu").otherwise("mine")
    a = table(spark, d, "events").select(F.concat(F.lit("t"), (u % 3).cast("string")).alias("tenant"), name.alias("name"), F.when(u % 2 == 0, "read").otherwise("write").alias("access")).distinct()
    imports = spark.createDataFrame([("t0", "partner", "t9", "out")], "tenant string, local string, owner string, remote string")
    exports = spark.createDataFrame([("t9", "out.orders", "read", "t0"), ("t9", "out", "both", "t5")], "owner string, prefix string, access string, audience string")
    return admin.share(a, imports, exports)


@query("scope_checks", "SELECT user_id, user_id % 2 = 0 AS can_publish, user_id % 3 = 0 AS can_admin FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    u = F.col("user_id")
    granted = F.array_compact(F.array(F.when(u % 2 == 0, "publish"), F.when(u % 3 == 0, "admin")))
    return table(spark, d, "events").select("user_id").distinct().select("user_id", admin.has_scope(granted, "publish").alias("can_publish"), admin.has_scope(granted, "admin").alias("can_admin"))


# the mix in 128 bits: products stay below 2^97, remainders bring them back to 64 bits
_A, _B = sampling.MIX
SAMPLING_SQL = f"""WITH a AS (SELECT event_id, event_type, event_id::HUGEINT * {_A} % 18446744073709551616 AS x FROM events),
    b AS (SELECT *, x * 2147483648 % 18446744073709551616 + x // 8589934592 AS y FROM a),
    c AS (SELECT *, ((y // 4294967296) * {_B} % 4294967296 * 4294967296 + (y % 4294967296) * {_B}) % 18446744073709551616 AS z FROM b)
    SELECT event_id, event_type = 'error' OR z // 2048 < 2251799813685248 AS recorded FROM c"""


@query("trace_sampling", SAMPLING_SQL)
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", sampling.sampled(F.col("event_id"), 0.25, F.col("event_type") == "error").alias("recorded"))
