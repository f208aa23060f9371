"""Queries of opstables.functions.scalars, schedules and sources."""

from pyspark.sql import functions as F

from opstables.functions import scalars as S
from opstables.operators import audit, schedule
from opstables.plans.fixtures import EVENTS_AS_OF
from opstables.plans.registry import query
from opstables.sources import tables


@query(
    "f1_priority_rank", "orders",
    """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 3 END AS rank FROM orders""",
)
def _(orders):
    name = F.element_at(F.array(*map(F.lit, ("very_high", "HIGH", "normal", "low", "Tide", "urgent", ""))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return orders.select(F.col("o_orderkey").alias("id"), S.priority_rank(name).alias("rank"))


@query(
    "f1_priority_name", "tasks",
    "SELECT task_id, CASE attempt WHEN 1 THEN 'very_high' WHEN 2 THEN 'high' WHEN 3 THEN 'normal' WHEN 4 THEN 'low' ELSE 'normal' END AS name FROM tasks",
)
def _(tasks):
    return tasks.select("task_id", S.priority_name(F.col("attempt")).alias("name"))


@query(
    "f2_score", "queue_entries",
    """SELECT task_id, CAST(floor(score / 10000000000000) AS BIGINT) AS rank, score % 10000000000000 AS ms, CAST(floor(score / 10000000000000) AS BIGINT) * 10000000000000 + score % 10000000000000 AS score FROM queue_entries""",
)
def _(entries):
    s = F.col("score")
    return entries.select("task_id", S.score_rank(s).alias("rank"), S.score_ms(s).alias("ms"), S.score(S.score_rank(s), S.score_ms(s)).alias("score"))


@query(
    "f3_f5_delays", "callback_outbox",
    """SELECT id, [10, 30, 60, 300, 900, 1800, 3600][greatest(1, least(attempt_count, 7))] AS callback, least(600, CAST(10 * pow(2, attempt_count - 1) AS BIGINT)) AS durable,
              least(600000, CAST(10000 * pow(2, attempt_count) AS BIGINT)) AS requeue_ms FROM callback_outbox""",
)
def _(outbox):
    n = F.col("attempt_count")
    return outbox.select("id", S.callback_delay(n).alias("callback"), S.durable_delay(n).alias("durable"), S.requeue_delay_ms(n).alias("requeue_ms"))


@query("f6_backoff", "callback_outbox")
def _(outbox):
    n = F.col("attempt_count")
    return outbox.select("id", S.step_backoff(F.lit(1.0), n, 7).alias("step_s"), S.client_backoff(n).alias("client_s"))


@query(
    "f6_client_backoff", "callback_outbox",
    "SELECT id, least(0.1 * pow(2, attempt_count), 30) AS client_s, least(pow(2, attempt_count), 60) AS least_s, least(1.2 * pow(2, attempt_count), 60) AS most_s, true AS within FROM callback_outbox",
)
def _(outbox):
    n = F.col("attempt_count")
    bounds = (F.least(F.pow(F.lit(2.0), n), F.lit(60.0)), F.least(F.lit(1.2) * F.pow(F.lit(2.0), n), F.lit(60.0)))
    step = S.step_backoff(F.lit(1.0), n, 7)
    return outbox.select("id", S.client_backoff(n).alias("client_s"), bounds[0].alias("least_s"), bounds[1].alias("most_s"), step.between(*bounds).alias("within"))


@query(
    "f7_cron_task_id", "tasks",
    """SELECT task_id, concat('cron-', left(replace(k, ':', '-'), 60), '-', left(sha256(k), 16)) AS cron_id FROM (SELECT task_id, concat('cron:', CAST(task_id AS VARCHAR), ':', repeat('x', CAST(task_id % 80 AS INT))) AS k FROM tasks)""",
)
def _(tasks):
    key = F.concat(F.lit("cron:"), F.col("task_id").cast("string"), F.lit(":"), F.expr("repeat('x', CAST(task_id % 80 AS INT))"))
    return tasks.select("task_id", S.cron_task_id(key).alias("cron_id"))


@query("f8_cron_key", "health_checks", "SELECT id, concat('cron:', CAST(entity AS VARCHAR), ':', CAST(epoch_us(ts) // 60000000 * 60 AS VARCHAR)) AS key FROM health_checks")
def _(checks):
    return checks.select("id", S.cron_key(F.col("entity"), F.col("ts")).alias("key"))


@query(
    "f10_epoch_iso", "orders",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE strftime(make_timestamp((o_orderkey % 5) * 1000000 * o_orderkey), '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders",
)
def _(orders):
    return orders.select(F.col("o_orderkey").alias("id"), S.epoch_iso(F.col("o_orderkey") % 5 * F.col("o_orderkey")).alias("iso"))


@query(
    "f11_effective_resources", "nodes",
    """SELECT node_id, CASE WHEN node_id % 3 > 0 AND node_id % 2 = 0 THEN cpus * 2.0 ELSE cpus END AS cpu,
              CASE WHEN node_id % 3 > 0 AND node_id % 2 = 0 AND node_id % 5 > 0 THEN CAST(node_id % 5 AS BIGINT) ELSE 64 END AS memory_mb FROM nodes""",
)
def _(nodes):
    synced = F.when(F.col("node_id") % 2 == 0, F.create_map(F.lit("cpu"), F.col("cpus") * 2.0, F.lit("memory"), (F.col("node_id") % 5 * 1048576).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    rows = nodes.withColumn("synced", synced)
    ts = F.col("node_id") % 3
    return rows.select("node_id", S.effective(F.col("synced"), ts, "cpu", F.col("cpus").cast("double")).alias("cpu"), S.effective_memory_mb(F.col("synced"), ts, F.lit(64)).alias("memory_mb"))


@query("f12_json_or_default", "tasks", "SELECT task_id, CASE WHEN input_data LIKE '{%' THEN 1 ELSE 0 END AS entries FROM tasks")
def _(tasks):
    return tasks.select("task_id", F.size(audit.json_map(F.col("input_data"))).alias("entries"))


@query("f13_truncated", "documents", "SELECT doc_id, left(text, 2000) AS error FROM documents")
def _(documents):
    return documents.select("doc_id", S.truncated(F.col("text")).alias("error"))


@query(
    "f14_masked", "customer",
    """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '****' ELSE concat(left(c_name, 4), '***', right(c_name, 4)) END AS masked FROM customer""",
)
def _(customer):
    return customer.select(F.col("c_custkey").alias("id"), S.masked(F.expr("CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN left(c_name, 8) ELSE c_name END")).alias("masked"))


@query("f15_f16_names", "tasks", "SELECT task_id, concat('buf:', CAST(task_id AS VARCHAR), ':x') AS buffer, concat('http://', capability, ':8', CAST(attempt AS VARCHAR)) AS url, concat('task_lock:', CAST(task_id AS VARCHAR)) AS lock FROM tasks")
def _(tasks):
    t = F.col("task_id")
    return tasks.select("task_id", S.filled(F.lit("buf:{task_id}:x"), t).alias("buffer"), S.agent_url(F.col("capability"), F.col("attempt") + 80).alias("url"), S.lock_key(t).alias("lock"))


@query("f17_resources", "clusters", "SELECT cluster_id, available_gpus AS gpus, available_cpus AS cpus FROM clusters")
def _(clusters):
    flat = clusters.withColumnsRenamed({"available_gpus": "available_gpus", "available_cpus": "available_cpus"})
    nested = flat.select("cluster_id", S.nested_resources("available_", "gpus", "cpus").alias("resources"))
    return nested.select("cluster_id", "resources.*")


@query("f18_utilization", "nodes", "SELECT node_id, CASE WHEN gpus > 0 THEN round(cpus / gpus, 2) ELSE 0 END AS utilization FROM nodes")
def _(nodes):
    return nodes.select("node_id", S.utilization(F.col("cpus"), F.col("gpus")).alias("utilization"))


@query("f19_seconds", "health_checks", "SELECT id, round(duration_seconds, 3) AS seconds FROM health_checks")
def _(checks):
    return checks.select("id", S.seconds_3dp(F.col("duration_seconds")).alias("seconds"))


@query(
    "f9_next_fire", "customer",
    """WITH c AS (SELECT c_custkey AS schedule_id, c_custkey % 4 AS k FROM customer)
       SELECT schedule_id, epoch_us(CASE k WHEN 0 THEN TIMESTAMP '2024-01-31 12:15:00' WHEN 1 THEN TIMESTAMP '2024-02-01 06:30:00' WHEN 2 THEN TIMESTAMP '2024-02-04 00:00:00' ELSE TIMESTAMP '2024-02-29 23:59:00' END) AS next_fire_at FROM c""",
)
def _(customer):
    crons = F.element_at(F.array(*map(F.lit, ("*/15 * * * *", "30 6 1 * *", "0 0 * * sun", "59 23 29 feb *"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = customer.select(F.col("c_custkey").alias("schedule_id"), crons.alias("cron"))
    return schedule.next_fire(rows, "cron", "2024-01-31 12:00:00").drop("cron")


@query(
    "f9_all_fires", "nation",
    """SELECT n_nationkey AS schedule_id, epoch_us(t) AS fire_at FROM nation, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 MINUTE)) AS t)
       WHERE t < TIMESTAMP '2024-01-31 00:00:00' AND extract(minute FROM t) IN (0, 20, 40) AND extract(hour FROM t) IN (8, 9, 10, 18)
         AND (extract(day FROM t) = 13 OR extract(dow FROM t) IN (1, 2, 3, 4, 5))""",
)
def _(nation):
    rows = nation.select(F.col("n_nationkey").alias("schedule_id"), F.lit("*/20 8-10,18 13 jan mon-fri").alias("cron"))
    return schedule.fires(rows, "cron", "2024-01-01 00:00:00", "2024-01-31 00:00:00").drop("cron")


@query(
    "g8_due_schedules", "schedules",
    f"""SELECT schedule_id, tenant_id FROM schedules WHERE enabled AND try_cast(next_fire_at AS TIMESTAMP) <= TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(schedules):
    return schedule.due_schedules(schedules, "2024-01-15 00:00:00").select("schedule_id", "tenant_id")


@query(
    "t9_fire_schedules", "schedules",
    """WITH d AS (SELECT schedule_id, tenant_id, concat('cron:', CAST(schedule_id AS VARCHAR), ':', CAST(epoch_us(TIMESTAMP '2024-01-15 00:00:00') // 1000000 AS VARCHAR)) AS k FROM schedules WHERE enabled AND try_cast(next_fire_at AS TIMESTAMP) <= TIMESTAMP '2024-01-15 00:00:00')
       SELECT schedule_id, tenant_id, k AS idempotency_key, concat('cron-', left(replace(k, ':', '-'), 60), '-', left(sha256(k), 16)) AS task_id FROM d""",
)
def _(schedules):
    return schedule.fire(schedule.due_schedules(schedules, "2024-01-15 00:00:00"), "2024-01-15 00:00:30")


@query("s2_cache_snapshot", "tasks", "SELECT json_extract_string(input_data, '$.n') AS n FROM tasks WHERE input_data LIKE '{%'")
def _(tasks):
    return tables.parse_cache_snapshot(tasks, "input_data", "n string")


@query("s3_live", "alerts", f"SELECT id FROM alerts WHERE starts_at + INTERVAL 604800 SECOND > TIMESTAMP '{EVENTS_AS_OF}'")
def _(alerts):
    return tables.live(alerts, "starts_at", 7 * 86400, EVENTS_AS_OF).select("id")


@query(
    "s6_explode_alerts", "events",
    """SELECT event_id AS payload_id, 'firing' AS status, 'rule' AS alertname, CAST(user_id AS VARCHAR) AS service FROM events
       UNION ALL SELECT event_id, 'resolved', 'rule', event_type FROM events""",
)
def _(events):
    raw = F.format_string('{"alerts":[{"status":"firing","labels":{"alertname":"rule","service":"%s"}},{"status":"resolved","labels":{"alertname":"rule","service":"%s"}}]}', F.col("user_id").cast("string"), "event_type")
    found = tables.explode_alerts(events.select(F.col("event_id").alias("payload_id"), raw.alias("raw")), "raw")
    return found.selectExpr("payload_id", "status", "labels['alertname'] AS alertname", "labels['service'] AS service")


@query("s1_read_table", "nation", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def _(nation):
    from opstables.sources import tables

    # declared columns that a file lacks are null, those that aren't declared aren't read
    return tables.read_table(nation.sparkSession, "nation", nation.inputFiles()[0], schema="n_nationkey int, n_name string, note string")


@query("s1_json_fields", "task_events", "SELECT id, CAST(json_extract_string(event_payload, '$.k') AS BIGINT) AS k FROM task_events")
def _(events):
    return events.select("id", F.from_json("event_payload", "k bigint")["k"].alias("k"))


@query("d1_worker", "tasks", "SELECT task_id, CAST(attempt * 2 + 1 AS BIGINT) AS result FROM tasks")
def _(tasks):
    from opstables.operators import udf

    class Doubler(udf.Worker):
        def pre_process(self, batch):
            return batch.assign(attempt=batch["attempt"].astype("int64"))

        def call(self, batch):
            return batch.assign(result=batch["attempt"] * 2)

        def post_process(self, batch):
            return batch.assign(result=batch["result"] + 1)[["task_id", "result"]]

    return udf.apply_worker(tasks.select("task_id", "attempt"), Doubler, "task_id bigint, result bigint")


@query(
    "d2_dispatch", "tasks",
    """SELECT task_id, CASE capability WHEN 'cap-1' THEN task_id * 2 WHEN 'cap-2' THEN task_id + 1 END AS result,
              CASE WHEN capability NOT IN ('cap-1', 'cap-2') THEN concat('unknown capability ', capability) END AS error FROM tasks""",
)
def _(tasks):
    from opstables.operators import udf

    functions = {"cap-1": lambda p: p.assign(result=p["task_id"] * 2), "cap-2": lambda p: p.assign(result=p["task_id"] + 1)}
    return udf.dispatch_by_capability(tasks.select("task_id", "capability"), functions, "task_id bigint, result bigint")


@query("d3_output_contract", "tasks", "SELECT task_id, status FROM tasks")
def _(tasks):
    from opstables.operators import udf

    return udf.assert_output(tasks.select("task_id", "status"), {"task_id": "bigint", "status": "string"}, allow_extra=False)


@query("d4_observed_calls", "tasks", "SELECT count(*) AS calls, count(*) FILTER (capability = 'cap-1') AS cap_1 FROM tasks")
def _(tasks):
    from opstables.operators import udf

    seen_df, seen = udf.observe_calls(tasks, {"cap_1": F.col("capability") == "cap-1"})
    seen_df.write.format("noop").mode("overwrite").save()
    return tasks.sparkSession.createDataFrame([seen.get], "calls bigint, cap_1 bigint")
