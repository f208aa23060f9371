"""Queries of opstables.operators.metrics and rules over time."""

from pyspark.sql import functions as F

from opstables.operators import alerts as A
from opstables.operators import metrics as M
from opstables.operators import vectors as V
from opstables.operators.ranks import split_sum
from opstables.plans import recursion
from opstables.plans.registry import query


@query("a8_counters", "tasks", "SELECT capability, priority_rank, status, count(*) AS n FROM tasks GROUP BY ALL")
def _(tasks):
    return M.count_by(tasks, "capability", "priority_rank", "status")


_BOUNDS = (1.0, 5.0, 20.0, 60.0, 120.0)
_HIST = f"""h AS (SELECT capability, le, count(*) FILTER (duration_seconds <= le) AS cumulative, count(*) AS count
   FROM health_checks, (SELECT unnest([{', '.join(map(str, _BOUNDS))}, CAST('inf' AS DOUBLE)]) AS le) GROUP BY capability, le)"""


@query(
    "a9_histogram", "health_checks",
    f"WITH {_HIST} SELECT capability, coalesce(nullif(CAST(le AS VARCHAR), 'inf'), '+Inf') AS le, cumulative, count FROM h",
)
def _(checks):
    hist = M.histogram(checks, "duration_seconds", ["capability"], _BOUNDS)
    return hist.select("capability", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")).alias("le"), "cumulative", "count")


@query(
    "a10_bucket_quantile", "health_checks",
    f"""WITH {_HIST}, w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY capability ORDER BY le), 0) AS lo, coalesce(lag(cumulative) OVER (PARTITION BY capability ORDER BY le), 0) AS below, 0.6 * count AS rank FROM h),
        c AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY le) AS r FROM w WHERE cumulative >= rank AND (below < rank OR below = 0))
        SELECT capability, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (cumulative - below) END, 6) AS quantile FROM c WHERE r = 1""",
)
def _(checks):
    hist = M.histogram(checks, "duration_seconds", ["capability"], _BOUNDS)
    return M.bucket_quantile(hist, 0.6, ["capability"]).withColumn("quantile", F.round("quantile", 6))


@query(
    "a11_latency_summary", "health_checks",
    """WITH r AS (SELECT capability, duration_seconds AS v, row_number() OVER (PARTITION BY capability ORDER BY duration_seconds) - 1 AS i, count(*) OVER (PARTITION BY capability) AS n FROM health_checks)
       SELECT capability, max(n) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = floor(n * 0.9)) AS p90,
              max(v) FILTER (i = floor(n * 0.95)) AS p95, max(v) FILTER (i = floor(n * 0.99)) AS p99, round(max(n) / (sum(v) / 1000), 6) AS tps FROM r GROUP BY capability""",
)
def _(checks):
    found = M.latency_summary(checks, "duration_seconds", ["capability"])
    return found.withColumns({"mean": F.round("mean", 6), "tps": F.round("tps", 6)})


_COUNTER = "s AS (SELECT capability, epoch_us(ts) // 1000000 AS t, CAST(sum(id % 100) AS DOUBLE) AS value FROM health_checks GROUP BY ALL)"


def _counter(checks):
    return checks.groupBy("capability", F.unix_seconds("ts").alias("t")).agg(F.sum(F.col("id") % 100).cast("double").alias("value"))


_INC = f"""WITH {_COUNTER}, i AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value >= lag(value) OVER w THEN value - lag(value) OVER w ELSE value END AS inc FROM s WINDOW w AS (PARTITION BY capability ORDER BY t)),
   g AS (SELECT capability, t, sum(inc) OVER (PARTITION BY capability ORDER BY t RANGE BETWEEN 35999 PRECEDING AND CURRENT ROW) AS inc FROM i)"""


@query("a12_counter_increase", "health_checks", f"{_INC} SELECT capability, t, inc AS increase FROM g")
def _(checks):
    return M.counter_increase(_counter(checks), ["capability"], 36000)


@query("a12_counter_rate", "health_checks", f"{_INC} SELECT capability, t, round(inc / 36000, 9) AS rate FROM g")
def _(checks):
    return M.counter_rate(_counter(checks), ["capability"], 36000).withColumn("rate", F.round("rate", 9))


@query(
    "a13_success_ratio", "tasks",
    """SELECT capability, count(*) AS n, round(count(*) FILTER (status <> 'failed') / count(*), 9) AS success, round(count(*) FILTER (status = 'failed') / count(*), 9) AS failure FROM tasks GROUP BY 1""",
)
def _(tasks):
    return M.success_ratio(tasks, ["capability"]).withColumns({"success": F.round("success", 9), "failure": F.round("failure", 9)})


@query("c21_ratio_ignoring", "tasks", "SELECT capability, tenant_id, round(count(*) FILTER (status = 'failed') / count(*), 9) AS ratio FROM tasks GROUP BY ALL")
def _(tasks):
    return M.ratio_ignoring(tasks, "status", "failed", ["capability", "tenant_id"]).withColumn("ratio", F.round("ratio", 9))


@query(
    "c21_failure_rate", "events",
    """WITH g AS (SELECT concat('cap-', CAST(user_id % 8 AS VARCHAR)) AS capability, CASE WHEN user_id % 3 > 0 THEN concat('tenant-', CAST(user_id % 3 AS VARCHAR)) END AS tenant_id, event_type AS status,
              epoch_us(CAST(ts AS TIMESTAMP)) // 3600000000 * 3600 AS t, count(*) AS n FROM events GROUP BY ALL),
       c AS (SELECT *, sum(n) OVER (PARTITION BY capability, tenant_id, status, t // 604800 ORDER BY t) AS total FROM g),
       i AS (SELECT *, CASE WHEN lag(total) OVER w IS NULL THEN 0 WHEN total >= lag(total) OVER w THEN total - lag(total) OVER w ELSE total END AS inc FROM c WINDOW w AS (PARTITION BY capability, tenant_id, status ORDER BY t)),
       r AS (SELECT *, sum(inc) OVER (PARTITION BY capability, tenant_id, status ORDER BY t RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) / 21600 AS rate FROM i),
       d AS (SELECT capability, tenant_id, t, sum(rate) AS rate FROM r GROUP BY ALL)
       SELECT r.capability, r.tenant_id, r.status, r.t, round(r.rate / d.rate, 9) AS value FROM r JOIN d ON r.capability = d.capability AND r.tenant_id IS NOT DISTINCT FROM d.tenant_id AND r.t = d.t
       WHERE r.status = 'error' AND d.rate > 0 AND r.rate / d.rate > 0.05""",
)
def _(events):
    """Counters by capability, tenant and status, hourly, that start anew each week: rate of the failed / ignoring(status) group_left sum without(status) of all > 0.05."""
    by = ["capability", "tenant_id", "status"]
    tenant = F.expr("CASE WHEN user_id % 3 > 0 THEN concat('tenant-', user_id % 3) ELSE '' END")  # an empty label is none
    counts = events.groupBy(F.expr("concat('cap-', user_id % 8)").alias("capability"), tenant.alias("tenant_id"), F.col("event_type").alias("status"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600000000 * 3600").alias("t")).agg(F.count("*").alias("n"))
    week = counts.withColumn("week", F.expr("t DIV 604800"))
    counters = split_sum(week, [*by, "week"], "t", [], "n", "value")
    rates = V.labelled(M.counter_rate(counters, by, 21600), by, "t", "rate")
    failed = rates.where(F.col("labels")["status"] == "error")
    ratios = V.match(failed, V.total(rates, without=("status",)), "/", ignoring=("status",), group="left")
    return V.compare(ratios, ">", 0.05).select(*(F.try_element_at("labels", F.lit(c)).alias(c) for c in by), "t", F.round("value", 9).alias("value"))


@query("a19_throughput", "health_checks", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, capability, count(*) AS n FROM health_checks GROUP BY ALL")
def _(checks):
    return M.throughput(checks, "ts", "1 hour", ["capability"])


@query(
    "a19_depth_trend", "task_events",
    """SELECT task_id, id, CAST(sum(CASE event WHEN 'enqueue' THEN 1 WHEN 'start' THEN -1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM task_events""",
)
def _(events):
    return M.depth_trend(events, ["task_id"])


@query("a20_gauge_max", "health_checks", "SELECT capability, max(duration_seconds) AS max_value, max(duration_seconds) > 100 AS breached FROM health_checks GROUP BY 1")
def _(checks):
    return M.gauge_max(checks, "duration_seconds", ["capability"], 100)


_GRID = "e AS (SELECT capability, epoch_us(ts) // 86400000000 * 86400 AS t, avg(duration_seconds) > 45 AS \"on\", max(duration_seconds) AS top FROM health_checks GROUP BY 1, 2)"


def _grid(checks):
    day = F.expr("unix_seconds(ts) DIV 86400 * 86400")
    return checks.groupBy("capability", day.alias("t")).agg((F.avg("duration_seconds") > 45).alias("on"), F.max("duration_seconds").alias("top"))


@query(
    "e17_for_duration", "health_checks",
    f"""WITH {_GRID}, i AS (SELECT *, sum(CASE WHEN "on" THEN 0 ELSE 1 END) OVER (PARTITION BY capability ORDER BY t) AS g FROM e)
        SELECT capability, min(t) AS since, max(t) AS until FROM i WHERE "on" GROUP BY capability, g HAVING max(t) - min(t) >= 172800""",
)
def _(checks):
    return A.for_duration(_grid(checks), ["capability"], 172800)


@query(
    "e18_rules", "health_checks",
    f"""WITH {_GRID}, r AS (SELECT capability, t, top AS value, 'TopHigh' AS alertname, 'warning' AS severity, 86400 AS d, top > 150 AS hit FROM e
          UNION ALL SELECT capability, t, top, 'TopCritical', 'critical', 0, top > 250 FROM e),
        i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY alertname, capability ORDER BY t) AS g FROM r)
        SELECT alertname, severity, capability AS labels, min(t) AS starts_at, arg_max(value, t) AS value FROM i WHERE hit GROUP BY alertname, severity, capability, d, g HAVING max(t) - min(t) >= d""",
)
def _(checks):
    samples = _grid(checks).select(F.lit("top").alias("metric"), F.col("capability").alias("labels"), "t", F.col("top").alias("value"))
    return A.evaluate_rules(samples, [("TopHigh", "top", "value > 150", 86400, "warning"), ("TopCritical", "top", "value > 250", 0, "critical"), ("Other", "depth", "value > 1", 0, "info")])


_RULES = ", ".join(f"('{a}', '{m}', '{op}', CAST({x} AS DOUBLE), {d}, '{sev}')" for a, m, op, x, d, sev in A.CATALOGUE)
_SERVICE = "CASE WHEN user_id % 2 = 0 THEN 'task-api' ELSE 'ops-api' END"
#: (label set, metric, value) over the sums of an hour: n, bad, done, top, q95, q99.
_METRICS = (
    ("service", "service_up", "CASE WHEN n = bad THEN 0 ELSE 1 END"),
    ("service", "http_error_ratio", "bad / n"),
    ("service", "http_p99", "q99 / 20"),
    ("capability", "queue_depth", "20 * n"),
    ("capability", "stalled_depth", "CASE WHEN done = 0 THEN 20 * n ELSE 0 END"),
    ("capability", "task_failure_ratio", "bad / n"),
    ("capability", "task_p95", "q95"),
    ("store", "store_up", "CASE WHEN bad >= 4 THEN 0 ELSE 1 END"),
    ("store", "store_breaker_state", "CASE WHEN bad >= 3 THEN 2 ELSE 0 END"),
    ("store", "store_degraded", "CASE WHEN bad >= 2 THEN 1 ELSE 0 END"),
    ("store", "store_degraded_queue", "60 * bad"),
    ("store", "store_p95", "q95 / 1000"),
    ("store", "db_idle", "CASE WHEN n >= 16 THEN 0 ELSE 16 - n END"),
    ("store", "db_p95", "q95 / 100"),
    ("service", "memory_mb", "5 * top"),
)
_LES = f"[{', '.join(map(str, M.BOUNDS))}, CAST('inf' AS DOUBLE)]"


def _quantile_sql(q: float, name: str) -> str:
    return f"""{name} AS (SELECT kind, labels, t, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * ({q} * count - below) / (cumulative - below) END AS q FROM (
       SELECT *, row_number() OVER (PARTITION BY kind, labels, t ORDER BY le) AS r FROM lagged WHERE cumulative >= {q} * count AND (below < {q} * count OR below = 0)) WHERE r = 1)"""


@query(
    "e18_rule_catalogue", "events",
    f"""WITH b AS (SELECT 'service' AS kind, {_SERVICE} AS labels, * FROM events UNION ALL SELECT 'capability', concat('cap-', CAST(user_id % 8 AS VARCHAR)), * FROM events UNION ALL SELECT 'store', 'store', * FROM events),
       e AS (SELECT kind, labels, epoch_us(CAST(ts AS TIMESTAMP)) // 3600000000 * 3600 AS t, event_type, value FROM b),
       g AS (SELECT kind, labels, t, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'purchase') AS done, max(value) AS top FROM e GROUP BY ALL),
       h AS (SELECT kind, labels, t, le, count(*) FILTER (value <= le) AS cumulative, count(*) AS count FROM e, (SELECT unnest({_LES}) AS le) GROUP BY ALL),
       lagged AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cumulative) OVER w, 0) AS below FROM h WINDOW w AS (PARTITION BY kind, labels, t ORDER BY le)),
       {_quantile_sql(0.95, 'p95')}, {_quantile_sql(0.99, 'p99')},
       x AS (SELECT g.*, p95.q AS q95, p99.q AS q99 FROM g JOIN p95 USING (kind, labels, t) JOIN p99 USING (kind, labels, t)),
       m AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, labels, t, CAST({v} AS DOUBLE) AS value FROM x WHERE kind = '{k}'" for k, m, v in _METRICS)}),
       rules(alertname, metric, op, threshold, d, severity) AS (VALUES {_RULES}),
       hits AS (SELECT *, CASE op WHEN '>' THEN value > threshold ELSE value = threshold END AS hit FROM m JOIN rules USING (metric)),
       i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY alertname, labels ORDER BY t) AS run FROM hits)
       SELECT alertname, severity, labels, min(t) AS starts_at, round(arg_max(value, t), 6) AS value FROM i WHERE hit GROUP BY alertname, severity, labels, d, run HAVING max(t) - min(t) >= d""",
)
def _(events):
    labels = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(x).alias("labels")) for k, x in (("service", _SERVICE), ("capability", "concat('cap-', user_id % 8)"), ("store", "'store'"))))
    rows = events.select(F.inline(labels), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600000000 * 3600").alias("t"), "event_type", "value")
    by = ["kind", "labels", "t"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") == "purchase").alias("done"), F.max("value").alias("top"))
    hist = M.histogram(rows, "value", by)
    for q, name in ((0.95, "q95"), (0.99, "q99")):
        sums = sums.join(M.bucket_quantile(hist, q, by).withColumnRenamed("quantile", name), by)
    samples = F.array_compact(F.array(*(F.when(F.col("kind") == k, F.struct(F.lit(m).alias("metric"), F.expr(v).cast("double").alias("value"))) for k, m, v in _METRICS)))
    found = A.evaluate_rules(sums.select("labels", "t", F.inline(samples)), [(a, m, f"value {op} {x}", d, s) for a, m, op, x, d, s in A.CATALOGUE])
    return found.withColumn("value", F.round("value", 6))


@query("e19_notifications", "alerts", recursion.notifications())
def _(alerts):
    return A.notifications(alerts)


_TREE = [(i, sev, name, to, wait, A.GROUP_INTERVAL, again) for i, ((sev, name, to, again), wait) in enumerate(zip(A.RECEIVERS, A.ROUTE_WAITS, strict=True))]
_TREE.append((len(_TREE), None, None, A.DEFAULT_RECEIVER, A.DEFAULT_WAIT, A.GROUP_INTERVAL, A.DEFAULT_REPEAT))


@query("e19_routed_notifications", "alerts", recursion.routed_notifications(_TREE))
def _(alerts):
    return A.routed_notifications(alerts, A.routes(alerts.sparkSession))
