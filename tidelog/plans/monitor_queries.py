"""Alert and dashboard queries over metric samples made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import monitor
from tidelog.operators.reports import histogram
from tidelog.plans.registry import query
from tidelog.plans.report_queries import BOUNDS, HIST_SQL
from tidelog.sources.views import table

#: One sample an hour and event type: a cumulative count that starts anew every 100 hours.
SAMPLES_SQL = """h AS (SELECT event_type AS job, epoch_us(ts) // 3600000000 * 3600 AS ts, count(*) AS n FROM events GROUP BY 1, 2),
  samples AS (SELECT job, ts, sum(n) OVER (PARTITION BY job, ts // 360000 ORDER BY ts)::BIGINT AS value FROM h)"""


def samples(spark, d):
    from pyspark.sql import Window as W

    sec = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) * 3600
    h = table(spark, d, "events").groupBy(F.col("event_type").alias("job"), sec.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("job", F.expr("ts div 360000")).orderBy("ts")
    return h.select("job", "ts", F.sum("n").over(w).alias("value"))


DELTA_SQL = f"""WITH {SAMPLES_SQL}, l AS (SELECT *, lag(value) OVER (PARTITION BY job ORDER BY ts) AS b FROM samples),
  x AS (SELECT job, ts, CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END AS dv FROM l),
  inc AS (SELECT job, ts // 21600 * 21600 AS "window", sum(dv)::BIGINT AS increase FROM x GROUP BY 1, 2)"""


@query("counter_increase", DELTA_SQL + " SELECT * FROM inc WHERE increase > 0")
def _(spark, d):
    return monitor.increase(samples(spark, d), ["job"], 21_600).filter("increase > 0")


@query("counter_rate", DELTA_SQL + ' SELECT job, "window", increase, round(increase / 21600.0::DOUBLE, 9) AS rate FROM inc')
def _(spark, d):
    return monitor.rate(samples(spark, d), ["job"], 21_600)


@query(
    "histogram_quantile",
    f"""WITH {HIST_SQL}, l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS le0, coalesce(lag(cumulative) OVER w, 0) AS c0 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
    f AS (SELECT * FROM l WHERE cumulative >= 0.99 * "count" QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1)
    SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN le0 ELSE le0 + (le - le0) * ((0.99 * "count" - c0) / (cumulative - c0)) END, 6) AS quantile FROM f""",
)
def _(spark, d):
    h = histogram(table(spark, d, "events"), ["event_type"], F.col("value"), BOUNDS)
    return monitor.histogram_quantile(h, ["event_type"], 0.99)


@query("redelivery_ratio", DELTA_SQL + """ SELECT a."window", round(a.increase / greatest(b.increase, 1)::DOUBLE, 9) AS ratio FROM inc a JOIN inc b USING ("window") WHERE a.job = 'error' AND b.job = 'view'""")
def _(spark, d):
    inc = monitor.increase(samples(spark, d), ["job"], 21_600)
    return monitor.ratio(inc.filter("job = 'error'"), inc.filter("job = 'view'"), ["window"], "increase")


@query("shed_sum", DELTA_SQL + """ SELECT "window", sum(increase)::BIGINT AS total FROM inc WHERE job IN ('error', 'click', 'signup') GROUP BY "window" HAVING count(*) = 3""")
def _(spark, d):
    inc = monitor.increase(samples(spark, d), ["job"], 21_600).filter("job in ('error', 'click', 'signup')")
    return inc.groupBy("window").agg(F.sum("increase").alias("total"), F.count(F.lit(1)).alias("n")).filter("n = 3").drop("n")


@query("restart_changes", f"""WITH {SAMPLES_SQL}, l AS (SELECT job, ts, ts // 360000 AS v, lag(ts // 360000) OVER (PARTITION BY job ORDER BY ts) AS b FROM samples)
    SELECT job, ts // 86400 * 86400 AS "window", count(*) FILTER (v <> b) AS changes FROM l GROUP BY 1, 2""")
def _(spark, d):
    s = samples(spark, d).select("job", "ts", F.expr("ts div 360000").alias("value"))
    return monitor.changes(s, ["job"], 86_400)


@query(
    "alert_hold",
    f"""WITH {SAMPLES_SQL}, r AS (SELECT *, sum((value <= 60)::INT) OVER (PARTITION BY job ORDER BY ts) AS run FROM samples)
    SELECT job, min(ts) AS since, max(ts) AS until FROM r WHERE value > 60 GROUP BY job, run HAVING max(ts) - min(ts) >= 18000""",
)
def _(spark, d):
    return monitor.held(samples(spark, d), ["job"], F.col("value") > 60, 18_000)


@query("top_lag", f"""WITH {SAMPLES_SQL} SELECT job, ts, value, row_number() OVER (PARTITION BY ts ORDER BY value DESC, job) AS rank FROM samples QUALIFY rank <= 2""")
def _(spark, d):
    return monitor.top(samples(spark, d), "ts", "value", 2, "job")


@query("latest_threshold", f"""WITH {SAMPLES_SQL} SELECT job, max_by(value, ts) AS value, max(ts) AS ts FROM samples GROUP BY job HAVING max_by(value, ts) <> -1 AND max_by(value, ts) < 16777216 AND job SIMILAR TO '(click|view|error)'""")
def _(spark, d):
    return monitor.latest(samples(spark, d), ["job"]).filter("value <> -1 and value < 16777216 and job rlike '^(click|view|error)$'")


@query("latency_heatmap", """SELECT epoch_us(ts) // 86400000000 AS day, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 250) AS le_250, count(*) AS le_inf FROM events GROUP BY 1""")
def _(spark, d):
    day = F.timestamp_diff("DAY", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    v = F.col("value")
    return table(spark, d, "events").groupBy(day.alias("day")).agg(F.count_if(v <= 10).alias("le_10"), F.count_if(v <= 50).alias("le_50"), F.count_if(v <= 250).alias("le_250"), F.count(F.lit(1)).alias("le_inf"))


@query("ungrounded_metrics", "SELECT * FROM (VALUES ('ghost_bucket'), ('missing')) v(metric)")
def _(spark, d):
    asked = spark.createDataFrame([("click",), ("view_bucket",), ("ghost_bucket",), ("missing",), ("error_sum",)], "metric string")
    emitted = table(spark, d, "events").select(F.col("event_type").alias("metric")).distinct()
    return monitor.ungrounded(asked, emitted)


@query("stuck_streams", "SELECT event_type, max(event_id) AS last FROM events GROUP BY event_type HAVING 20000 - max(event_id) > 10001")
def _(spark, d):
    last = table(spark, d, "events").groupBy("event_type").agg(F.max("event_id").alias("last"))
    return last.filter(20_000 - F.col("last") > 10_001)
