"""Queries of opstables.operators.reconcile."""

from pyspark.sql import functions as F

from opstables.operators import reconcile as R
from opstables.operators import registry
from opstables.plans.fixtures import EVENTS_AS_OF, TASKS_AS_OF
from opstables.plans.registry import query

_MS = 800_060_000_000


@query(
    "c1_cache_rebuild", "tasks task_cache",
    """SELECT task_id, status, capability, coalesce(callback_url, '') AS callback_url, CASE WHEN timeout_seconds = 0 THEN 3600 ELSE timeout_seconds END AS timeout_seconds,
              CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END AS max_retries FROM tasks ANTI JOIN task_cache USING (task_id)""",
)
def _(tasks, cache):
    payload = F.from_json("payload", "status string, capability string, callback_url string, timeout_seconds int, max_retries int")
    return R.cache_rebuild(tasks, cache).select("task_id", payload.alias("p")).select("task_id", "p.*")


@query(
    "c2_queue_restore", "tasks queue_entries",
    f"""SELECT capability, task_id, priority_rank * 10000000000000 + {_MS} AS score FROM tasks t
        WHERE status IN ('queued', 'scheduled') AND NOT EXISTS (SELECT 1 FROM queue_entries q WHERE q.capability = t.capability AND q.task_id = t.task_id)""",
)
def _(tasks, entries):
    return R.queue_restore(tasks, entries, _MS)


@query(
    "c3_missing_durable", "tasks task_cache",
    """WITH c AS (SELECT * REPLACE (CASE WHEN task_id % 4 = 0 AND status = 'queued' THEN 'Cancelled' ELSE status END AS status), CASE WHEN task_id % 3 = 0 THEN concat('say "', CAST(attempt AS VARCHAR), '"') WHEN task_id % 3 = 1 THEN '' END AS output FROM task_cache)
       SELECT task_id, tenant_id, status, CASE WHEN output <> '' THEN concat('"say \\"', CAST(attempt AS VARCHAR), '\\""') END AS output_data, concat('reconciler-', left(CAST(task_id AS VARCHAR), 8)) AS tx_id,
              'create_task' AS tx_operation, 'failed' AS tx_status, true AS tx_durable_written, false AS tx_cache_written, 'detected by reconciler phase1' AS tx_error
       FROM c WHERE lower(status) IN ('completed', 'failed', 'cancelled') AND task_id NOT IN (SELECT task_id FROM tasks WHERE task_id % 5 <> 0)""",
)
def _(tasks, cache):
    output = F.expr("""CASE WHEN task_id % 3 = 0 THEN concat('say "', attempt, '"') WHEN task_id % 3 = 1 THEN '' END""")
    ended = cache.withColumns({"output": output, "status": F.expr("CASE WHEN task_id % 4 = 0 AND status = 'queued' THEN 'Cancelled' ELSE status END")})
    return R.missing_durable(ended, tasks.where("task_id % 5 <> 0"))


_STUCK = f"""stuck AS (SELECT * FROM task_cache WHERE status IN ('running', 'queued') AND (created_at IS NULL OR created_at <= TIMESTAMP '{TASKS_AS_OF}' - INTERVAL 300 SECOND)
   AND task_id NOT IN (SELECT task_id FROM leases) AND task_id % 10 <> 0"""


def _recent(cache):
    return cache.where("task_id % 10 = 0").select("task_id")


@query("c4_stuck_tasks", "task_cache leases", f"WITH {_STUCK} ORDER BY task_id LIMIT 20) SELECT task_id, status FROM stuck")
def _(cache, leases):
    return R.stuck_tasks(cache, leases, _recent(cache), TASKS_AS_OF).select("task_id", "status")


@query(
    "c5_stuck_disposition", "task_cache leases",
    f"""WITH {_STUCK}) SELECT task_id, capability, CASE WHEN attempt < max_retries THEN 'requeue' ELSE 'fail' END AS action,
        CASE WHEN attempt < max_retries THEN attempt + 1 ELSE attempt END AS attempt,
        CASE WHEN attempt < max_retries THEN least(600000, 10000 * CAST(pow(2, attempt) AS BIGINT)) END AS delay_ms,
        CASE WHEN attempt < max_retries THEN priority_rank END AS priority_rank,
        CASE WHEN attempt >= max_retries THEN 'stuck_without_lease' END AS reason FROM stuck""",
)
def _(cache, leases):
    return R.stuck_disposition(R.stuck_tasks(cache, leases, _recent(cache), TASKS_AS_OF, cap=None))


@query(
    "c6_lost_callbacks", "task_cache",
    f"""SELECT task_id, callback_url, 1 AS attempt, epoch_us(TIMESTAMP '{TASKS_AS_OF}') + 10000000 AS next_retry_us FROM task_cache
        WHERE status IN ('completed', 'failed') AND callback_url IS NOT NULL AND task_id % 2 <> 0 AND task_id % 5 <> 0""",
)
def _(cache):
    return R.lost_callbacks(cache, cache.where("task_id % 2 = 0"), cache.where("task_id % 5 = 0"), TASKS_AS_OF).drop("payload")


@query(
    "c7_active_missing", "tasks task_cache",
    f"""SELECT task_id, tenant_id, status, capability, 3 AS priority_rank FROM tasks WHERE status IN ('queued', 'running', 'scheduled')
        AND created_at >= TIMESTAMP '{TASKS_AS_OF}' - INTERVAL 9600 HOUR AND task_id NOT IN (SELECT task_id FROM task_cache)""",
)
def _(tasks, cache):
    return R.active_missing(tasks, cache, TASKS_AS_OF, hours=9600)


_TX = """SELECT event_id AS tx_id, event_id % 20000 AS task_id, CASE event_id % 3 WHEN 0 THEN 'create_task' WHEN 1 THEN 'update_status' ELSE 'drop' END AS operation,
   CASE event_id % 4 WHEN 0 THEN 'pending_redis' WHEN 1 THEN 'failed' ELSE 'committed' END AS status, CAST(event_id % 5 AS INT) AS retry_count FROM events"""


@query(
    "c8_repair_tx", "events tasks task_cache",
    f"""WITH tx AS ({_TX}), r AS (SELECT tx.*, t.status AS durable, c.task_id IS NOT NULL AS cached FROM tx LEFT JOIN tasks t ON t.task_id = tx.task_id LEFT JOIN task_cache c ON c.task_id = tx.task_id WHERE tx.status IN ('pending_redis', 'failed'))
        SELECT tx_id, task_id, CASE WHEN retry_count >= 3 OR durable IS NULL OR operation = 'drop' THEN 'expired' ELSE 'committed' END AS outcome,
               NOT (retry_count >= 3 OR durable IS NULL OR operation = 'drop') AND (operation = 'create_task' OR cached) AS has_payload FROM r""",
)
def _(events, tasks, cache):
    tx = events.selectExpr("event_id AS tx_id", "event_id % 20000 AS task_id", "CASE event_id % 3 WHEN 0 THEN 'create_task' WHEN 1 THEN 'update_status' ELSE 'drop' END AS operation",
                           "CASE event_id % 4 WHEN 0 THEN 'pending_redis' WHEN 1 THEN 'failed' ELSE 'committed' END AS status", "CAST(event_id % 5 AS INT) AS retry_count")
    return R.repair_tx(tx, tasks, cache).selectExpr("tx_id", "task_id", "outcome", "payload IS NOT NULL AS has_payload")


@query(
    "c9_idempotent_submit", "customer tasks",
    """WITH q AS (SELECT c_custkey AS request_id, concat('tenant-', CAST(c_custkey % 12 AS VARCHAR)) AS tenant_id, concat('key-', CAST(c_custkey % 60 AS VARCHAR)) AS k FROM customer),
            f AS (SELECT tenant_id, idempotency_key AS k, task_id, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY created_at, task_id) AS r FROM tasks WHERE idempotency_key IS NOT NULL)
       SELECT request_id, coalesce(CAST(task_id AS VARCHAR), concat('cron-', left(k, 60), '-', left(sha256(k), 16))) AS task_id, task_id IS NOT NULL OR request_id > min(request_id) OVER (PARTITION BY tenant_id, k) AS idempotent_reused
       FROM q LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (tenant_id, k)""",
)
def _(customer, tasks):
    requests = customer.selectExpr("c_custkey AS request_id", "concat('tenant-', c_custkey % 12) AS tenant_id", "concat('key-', c_custkey % 60) AS idempotency_key")
    return R.submit(requests, tasks)


@query(
    "c16_explain", "tasks leases task_cache",
    """SELECT t.task_id, l.task_id IS NOT NULL AS lease, c.task_id IS NOT NULL AS cached, true AS durable,
              CASE WHEN t.status = 'running' AND l.task_id IS NULL THEN 'repair' WHEN t.status IN ('failed', 'completed') THEN 'check_callback' ELSE 'inspect' END AS recommended_action,
              CASE WHEN l.task_id IS NULL THEN CASE WHEN t.status = 'running' THEN 'lease_missing|running_without_lease' ELSE 'lease_missing' END
                   ELSE 'consistent' END AS reasons
       FROM tasks t LEFT JOIN leases l ON l.task_id = t.task_id LEFT JOIN task_cache c ON c.task_id = t.task_id""",
)
def _(tasks, leases, cache):
    return R.explain(tasks, leases, cache).withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "c17_task_debug", "tasks queue_entries",
    """WITH p AS (SELECT task_id, row_number() OVER (PARTITION BY capability ORDER BY score, task_id) AS position FROM queue_entries WHERE queue_set = 'pending')
       SELECT t.task_id, t.status, queue_set, q.capability, position,
              CASE queue_set WHEN 'pending' THEN concat('wait in ', q.capability, ' at place ', CAST(position AS VARCHAR))
                             WHEN 'running' THEN concat('runs in ', q.capability) END AS recommendation
       FROM tasks t LEFT JOIN queue_entries q ON q.task_id = t.task_id LEFT JOIN p ON p.task_id = t.task_id""",
)
def _(tasks, entries):
    return R.task_debug(tasks, entries)


@query(
    "c18_overview", "queue_entries queue_config nation",
    """WITH b AS (SELECT concat('cap-', CAST(n_nationkey AS VARCHAR)) AS capability, CASE n_nationkey % 3 WHEN 0 THEN 'open' ELSE 'closed' END AS circuit_state FROM nation WHERE n_nationkey < 7),
       l AS (SELECT capability, count(*) FILTER (queue_set = 'pending') AS pending, count(*) FILTER (queue_set = 'running') AS running,
                    any_value(CASE WHEN max_concurrent > 0 THEN max_concurrent ELSE 8 END) AS max_concurrent FROM queue_entries LEFT JOIN queue_config USING (capability) GROUP BY 1)
       SELECT capability, pending, running, max_concurrent, coalesce(circuit_state, 'closed') AS circuit_state, round(running / max_concurrent, 2) AS utilization,
              CAST(sum(pending) OVER () AS BIGINT) AS total_pending, CAST(sum(running) OVER () AS BIGINT) AS total_running,
              CASE WHEN count(*) FILTER (circuit_state = 'open') OVER () > 0 THEN 'degraded' ELSE 'ok' END AS overall_status
       FROM l LEFT JOIN b USING (capability)""",
)
def _(entries, config, nation):
    breaker = nation.where("n_nationkey < 7").selectExpr("concat('cap-', n_nationkey) AS capability", "CASE n_nationkey % 3 WHEN 0 THEN 'open' ELSE 'closed' END AS circuit_state")
    return R.overview(entries, config, breaker)


@query(
    "c18_overview_tenant", "queue_entries queue_config nation tasks",
    """WITH b AS (SELECT concat('cap-', CAST(n_nationkey AS VARCHAR)) AS capability, CASE n_nationkey % 3 WHEN 0 THEN 'open' ELSE 'closed' END AS circuit_state FROM nation WHERE n_nationkey < 7),
       l AS (SELECT capability, count(*) FILTER (queue_set = 'pending') AS pending, count(*) FILTER (queue_set = 'running') AS running,
                    any_value(CASE WHEN max_concurrent > 0 THEN max_concurrent ELSE 8 END) AS max_concurrent FROM queue_entries LEFT JOIN queue_config USING (capability)
             WHERE capability IN (SELECT capability FROM tasks WHERE tenant_id = 'tenant-4') GROUP BY 1)
       SELECT capability, pending, running, max_concurrent, coalesce(circuit_state, 'closed') AS circuit_state, round(running / max_concurrent, 2) AS utilization,
              CAST(sum(pending) OVER () AS BIGINT) AS total_pending, CAST(sum(running) OVER () AS BIGINT) AS total_running, 'critical' AS overall_status FROM l LEFT JOIN b USING (capability)""",
)
def _(entries, config, nation, tasks):
    breaker = nation.where("n_nationkey < 7").selectExpr("concat('cap-', n_nationkey) AS capability", "CASE n_nationkey % 3 WHEN 0 THEN 'open' ELSE 'closed' END AS circuit_state")
    return R.overview(entries, config, breaker, tasks.where("tenant_id = 'tenant-4'"), reachable=False)


@query(
    "c19_replay_effects", "operator_actions",
    """WITH r AS (SELECT * FROM operator_actions WHERE action_type = 'task_replay_requested')
       SELECT id, target_id AS task_id, 'run' AS table_name, concat('replay-', CAST(id AS VARCHAR)) AS key, 'replay_requested' AS detail FROM r
       UNION ALL SELECT id, target_id, 'action', actor, 'task_replay_requested' FROM r UNION ALL SELECT id, target_id, 'event', concat('replay-', CAST(id AS VARCHAR)), 'replay' FROM r""",
)
def _(actions):
    return R.replay_effects(actions.where("action_type = 'task_replay_requested'"))


@query(
    "c20_dead_letter_ops", "operator_actions callback_outbox",
    """WITH c AS (SELECT id + 1 AS id, CASE id % 2 WHEN 0 THEN 'replay' ELSE 'acknowledge' END AS command, actor FROM operator_actions)
       SELECT c.id, command, o.id IS NOT NULL AS ok, CASE WHEN o.id IS NOT NULL AND command = 'replay' THEN 'pending' ELSE delivery_status END AS delivery_status,
              CASE WHEN o.id IS NOT NULL AND command = 'acknowledge' THEN actor END AS acknowledged_by
       FROM c LEFT JOIN (SELECT * FROM callback_outbox WHERE delivery_status = 'dead_letter') o ON o.id = c.id""",
)
def _(actions, outbox):
    commands = actions.selectExpr("id + 1 AS id", "CASE id % 2 WHEN 0 THEN 'replay' ELSE 'acknowledge' END AS command", "actor")
    return R.dead_letter_ops(outbox.where("delivery_status = 'dead_letter'"), commands)


_SUMMARY = ", ".join(f"count(*) FILTER (delivery_status = '{s}') AS {s}" for s in R.STATUSES) + ", count(*) AS total"


@query("a1_callback_summary", "callback_outbox", f"SELECT {_SUMMARY} FROM callback_outbox")
def _(outbox):
    return R.callback_summary(outbox)


@query(
    "a2_operator_dashboard", "callback_outbox operator_actions task_events",
    f"SELECT {_SUMMARY}, (SELECT count(*) FROM operator_actions) AS operator_actions, (SELECT count(*) FROM task_events) AS recent_timeline_events FROM callback_outbox",
)
def _(outbox, actions, events):
    return R.operator_dashboard(outbox, actions, events)


@query(
    "a3_platform_health", "task_runs callback_outbox operator_actions",
    f"""SELECT {_SUMMARY}, (SELECT least(count(*), 200) FROM task_runs WHERE status = 'running') AS stale_task_count,
        (SELECT least(count(*), 200) FROM callback_outbox WHERE delivery_status = 'dead_letter') AS dead_letter_backlog,
        (SELECT least(count(*), 10) FROM operator_actions) AS recent_operator_actions FROM callback_outbox""",
)
def _(runs, outbox, actions):
    return R.platform_health(runs, outbox, actions)


@query("a17_stale_count", "task_runs", "SELECT count(*) AS stale FROM task_runs WHERE status = 'running'")
def _(runs):
    return R.stale_count(runs)


@query(
    "a18_reconcile_report", "tasks task_cache queue_entries",
    """SELECT 'rebuild' AS phase, count(*) AS n FROM tasks ANTI JOIN task_cache USING (task_id) UNION ALL
       SELECT 'restore', count(*) FROM tasks t WHERE status IN ('queued', 'scheduled') AND NOT EXISTS (SELECT 1 FROM queue_entries q WHERE q.capability = t.capability AND q.task_id = t.task_id)""",
)
def _(tasks, cache, entries):
    return R.reconcile_report(rebuild=R.cache_rebuild(tasks, cache), restore=R.queue_restore(tasks, entries, _MS))


@query(
    "a16_recent_replays", "operator_actions",
    f"""SELECT target_id AS task_id, count(*) AS n FROM operator_actions WHERE action_type = 'task_replay_requested'
        AND created_at BETWEEN TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 864000 SECOND AND TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1""",
)
def _(actions):
    return R.recent_replays(actions, EVENTS_AS_OF, 864000)


@query(
    "s9_finalize", "tasks task_events",
    """WITH c AS (SELECT id * 7 AS task_id, CASE WHEN event = 'fail' THEN 'failed' ELSE 'completed' END AS outcome, repeat('x', 2500) AS error, CASE WHEN id % 2 = 0 THEN 'http://cb' ELSE '' END AS callback_url FROM task_events WHERE event IN ('complete', 'fail'))
       SELECT task_id, coalesce(outcome, status) AS status, CASE WHEN outcome = 'failed' THEN left(error, 2000) END AS error_message, outcome IS NOT NULL AND c.callback_url <> '' AS needs_callback
       FROM tasks FULL JOIN c USING (task_id)""",
)
def _(tasks, events):
    done = events.where("event IN ('complete', 'fail')").selectExpr("id * 7 AS task_id", "CASE WHEN event = 'fail' THEN 'failed' ELSE 'completed' END AS outcome", "repeat('x', 2500) AS error", "CASE WHEN id % 2 = 0 THEN 'http://cb' ELSE '' END AS callback_url")
    return R.finalize(tasks, done)


_DONE = """c AS (SELECT id * 7 AS task_id, CASE WHEN event = 'fail' THEN 'failed' ELSE 'completed' END AS outcome, CASE WHEN id % 2 = 0 THEN 'http://cb' ELSE '' END AS callback_url FROM task_events WHERE event IN ('complete', 'fail'))"""


def _done(events):
    return events.where("event IN ('complete', 'fail')").selectExpr("id * 7 AS task_id", "CASE WHEN event = 'fail' THEN 'failed' ELSE 'completed' END AS outcome", "CASE WHEN id % 2 = 0 THEN 'http://cb' ELSE '' END AS callback_url")


@query(
    "s9_outbox", "task_events",
    f"""WITH {_DONE} SELECT task_id, callback_url, concat('{{"task_id":', CAST(task_id AS VARCHAR), ',"status":"', outcome, '","timestamp":', CAST(epoch_us(TIMESTAMP '{EVENTS_AS_OF}') // 1000000 AS VARCHAR), '}}') AS payload_json,
        'pending' AS delivery_status, 0 AS attempt_count, epoch_us(TIMESTAMP '{EVENTS_AS_OF}') AS next_attempt_at FROM c WHERE callback_url <> ''""",
)
def _(events):
    return R.finalize_outbox(_done(events), EVENTS_AS_OF)


@query(
    "s9_events", "task_events",
    f"""WITH {_DONE} SELECT task_id, concat('task_', outcome) AS event_type, concat('{{"callback_url":"', callback_url, '"}}') AS event_payload, epoch_us(TIMESTAMP '{EVENTS_AS_OF}') AS created_at FROM c""",
)
def _(events):
    return R.finalize_events(_done(events), EVENTS_AS_OF)


@query(
    "t3_outbox_progress", "callback_outbox",
    f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'delivered' WHEN attempt_count + 1 >= 8 THEN 'dead_letter' ELSE 'pending' END AS delivery_status, attempt_count + 1 AS attempt_count,
        CASE WHEN id % 3 <> 0 AND attempt_count + 1 < 8 THEN epoch_us(TIMESTAMP '{EVENTS_AS_OF}') + [10, 30, 60, 300, 900, 1800, 3600][least(attempt_count + 1, 7)] * 1000000 END AS next_attempt_us
        FROM callback_outbox WHERE delivery_status = 'pending'""",
)
def _(outbox):
    return R.outbox_progress(outbox, outbox.selectExpr("id", "id % 3 = 0 AS delivered"), EVENTS_AS_OF)


@query(
    "s4_first_available", "task_cache tasks",
    """SELECT task_id, status, source FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY source) AS r FROM (
         SELECT task_id, status, 0 AS source FROM task_cache UNION ALL SELECT task_id, status, 1 FROM tasks)) WHERE r = 1""",
)
def _(cache, tasks):
    return registry.first_available(tasks, "task_id", cache.select("task_id", "status"), tasks.select("task_id", "status"))


@query(
    "s4_first_available_all", "task_cache tasks",
    """SELECT task_id, coalesce(c.status, t.status) AS status, CASE WHEN c.task_id IS NULL THEN 1 ELSE 0 END AS source FROM tasks t LEFT JOIN task_cache c USING (task_id)""",
)
def _(cache, tasks):
    return registry.first_available(tasks, "task_id", cache.select("task_id", "status"), tasks.select("task_id", "status"))


@query(
    "s12_merge_record", "tasks task_cache",
    """SELECT t.task_id, coalesce(c.status, t.status) AS status, coalesce(CASE WHEN c.attempt > 2 THEN c.attempt END, t.attempt) AS attempt, t.tenant_id FROM tasks t LEFT JOIN task_cache c ON c.task_id = t.task_id""",
)
def _(tasks, cache):
    patch = cache.selectExpr("task_id", "status", "CASE WHEN attempt > 2 THEN attempt END AS attempt")
    return registry.merge_record(tasks.select("task_id", "status", "attempt", "tenant_id"), patch, "task_id")


@query(
    "c10_resolve_keys", "customer tenants",
    """WITH k AS (SELECT sha256(c_name) AS h, concat('tenant-', CAST(c_custkey % 10 AS VARCHAR)) AS owner FROM customer WHERE c_custkey % 3 <> 0),
            q AS (SELECT c_custkey AS request_id, sha256(c_name) AS h, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'tenant-1' ELSE concat('tenant-', CAST(c_custkey % 10 AS VARCHAR)) END AS hint FROM customer),
            v AS (SELECT request_id, owner, CASE WHEN owner IS NULL THEN 'unknown key' WHEN hint IS NOT NULL AND hint <> owner THEN 'tenant mismatch' WHEN coalesce(status, '') <> 'active' THEN 'tenant not active' ELSE 'ok' END AS verdict
                  FROM q LEFT JOIN k USING (h) LEFT JOIN tenants ON tenant_id = owner)
       SELECT request_id, CASE WHEN verdict = 'ok' THEN owner END AS tenant_id, verdict FROM v""",
)
def _(customer, tenants):
    keys = customer.where("c_custkey % 3 <> 0").selectExpr("sha2(c_name, 256) AS key_hash", "concat('tenant-', c_custkey % 10) AS tenant_id")
    requests = customer.selectExpr("c_custkey AS request_id", "c_name AS api_key", "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'tenant-1' ELSE concat('tenant-', c_custkey % 10) END AS tenant_hint")
    return registry.resolve_keys(requests, keys, tenants)


@query(
    "c14_select_cluster", "tasks clusters",
    """WITH q AS (SELECT task_id AS request_id, tenant_id, CAST(task_id % 10 AS INT) AS gpus FROM tasks),
            r AS (SELECT request_id, cluster_id, row_number() OVER (PARTITION BY request_id ORDER BY available_gpus DESC, available_cpus DESC, cluster_id) AS k
                  FROM q JOIN clusters c ON status = 'active' AND (gpus <= 0 OR available_gpus >= gpus) AND (c.tenant_id = '' OR c.tenant_id = q.tenant_id))
       SELECT q.request_id, cluster_id FROM q LEFT JOIN (SELECT * FROM r WHERE k = 1) x ON x.request_id = q.request_id""",
)
def _(tasks, clusters):
    return registry.select_cluster(tasks.selectExpr("task_id AS request_id", "tenant_id", "CAST(task_id % 10 AS INT) AS gpus"), clusters.withColumn("cluster_id", F.col("cluster_id").cast("bigint")))


@query(
    "c14_select_by_capability", "tasks clusters",
    """WITH q AS (SELECT task_id AS request_id, CASE WHEN task_id % 6 <> 0 THEN tenant_id END AS tenant, CAST(task_id % 10 AS INT) AS gpus, CASE WHEN task_id % 4 <> 0 THEN capability END AS cap FROM tasks),
            c AS (SELECT *, [concat('cap-', CAST(cluster_id % 8 AS VARCHAR)), concat('cap-', CAST(cluster_id % 5 AS VARCHAR))] AS can FROM clusters),
            r AS (SELECT request_id, cluster_id, row_number() OVER (PARTITION BY request_id ORDER BY available_gpus DESC, available_cpus DESC, cluster_id) AS k
                  FROM q JOIN c ON status = 'active' AND (gpus <= 0 OR available_gpus >= gpus) AND (tenant IS NULL OR c.tenant_id = '' OR c.tenant_id = tenant) AND (cap IS NULL OR list_contains(can, cap)))
       SELECT q.request_id, cluster_id FROM q LEFT JOIN (SELECT * FROM r WHERE k = 1) x ON x.request_id = q.request_id""",
)
def _(tasks, clusters):
    requests = tasks.selectExpr("task_id AS request_id", "CASE WHEN task_id % 6 <> 0 THEN tenant_id END AS tenant_id", "CAST(task_id % 10 AS INT) AS gpus", "CASE WHEN task_id % 4 <> 0 THEN capability END AS capability")
    listed = clusters.withColumns({"cluster_id": F.col("cluster_id").cast("bigint"), "capabilities": F.expr("array(concat('cap-', cluster_id % 8), concat('cap-', cluster_id % 5))")})
    return registry.select_cluster(requests, listed)


@query(
    "c15_with_tenant", "schedules events",
    "SELECT event_id AS fire_id, user_id AS schedule_id, tenant_id FROM events LEFT JOIN schedules ON schedule_id = user_id",
)
def _(schedules, events):
    return registry.with_tenant(events.selectExpr("event_id AS fire_id", "user_id AS schedule_id"), schedules)


@query(
    "a6_tenant_usage", "tasks tenants",
    """WITH u AS (SELECT tenant_id, CAST(sum(task_id % 3) AS BIGINT) AS g, count(*) AS t, CAST(sum(attempt) AS BIGINT) AS a FROM tasks WHERE status IN ('running', 'queued') GROUP BY 1)
       SELECT tenant_id, coalesce(g, 0) AS gpu_count, coalesce(t, 0) AS task_count, coalesce(a, 0) AS actor_count,
              (max_gpus > 0 AND coalesce(g, 0) > max_gpus) OR (max_tasks > 0 AND coalesce(t, 0) > max_tasks) OR (max_actors > 0 AND coalesce(a, 0) > max_actors) AS over_quota
       FROM tenants LEFT JOIN u USING (tenant_id)""",
)
def _(tasks, tenants):
    return registry.tenant_usage(tasks.where("status IN ('running', 'queued')").selectExpr("tenant_id", "task_id % 3 AS gpus", "attempt AS actors"), tenants)


@query("a7_observed_resources", "nodes", "SELECT cluster_id, CAST(sum(gpus) AS BIGINT) AS total_gpus, CAST(sum(cpus) AS BIGINT) AS available_cpus, count(*) AS nodes FROM nodes WHERE state = 'joined' GROUP BY 1")
def _(nodes):
    return registry.observed_resources(nodes)
