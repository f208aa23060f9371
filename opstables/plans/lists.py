"""Queries of opstables.operators.audit."""

from opstables.operators import audit
from opstables.plans.fixtures import EVENTS_AS_OF
from opstables.plans.registry import query


@query("p1_list_tasks", "tasks", "SELECT task_id, status, capability FROM tasks WHERE tenant_id = 'tenant-3' AND status = 'queued'")
def _(tasks):
    return audit.list_tasks(tasks, "tenant-3", status="queued").select("task_id", "status", "capability")


@query(
    "p2_page", "tasks",
    """WITH a AS (SELECT task_id FROM tasks WHERE task_id > 100 ORDER BY task_id LIMIT 51),
       k AS (SELECT task_id FROM a ORDER BY task_id LIMIT 50)
       SELECT task_id, CASE WHEN (SELECT count(*) FROM a) > 50 THEN (SELECT max(task_id) FROM k) END AS next_cursor FROM k""",
)
def _(tasks):
    return audit.page(tasks.select("task_id"), "task_id", 100, 50)


@query(
    "p3_task_info", "tasks",
    """SELECT task_id, tenant_id, status, CASE WHEN input_data LIKE '{%' THEN json_extract_string(input_data, '$.n') END AS input_n,
              CASE WHEN timeout_seconds = 0 THEN 3600 ELSE timeout_seconds END AS timeout_seconds,
              CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END AS max_retries FROM tasks""",
)
def _(tasks):
    found = audit.task_info(tasks)
    return found.selectExpr("task_id", "tenant_id", "status", "input['n'] AS input_n", "timeout_seconds", "max_retries")


@query("p4_task_summary", "tasks", "SELECT task_id, tenant_id, capability, status, priority_rank, epoch_us(created_at) AS created_at FROM tasks")
def _(tasks):
    return audit.task_summary(tasks)


@query(
    "p5_task_results", "tasks",
    """SELECT task_id, status, status IN ('completed', 'failed') AS available,
              CASE WHEN status NOT IN ('completed', 'failed') THEN 'not yet available' END AS message FROM tasks""",
)
def _(tasks):
    return audit.task_results(tasks)


@query("p6_visible", "tasks", "SELECT task_id, tenant_id FROM tasks WHERE tenant_id = 'tenant-1'")
def _(tasks):
    return audit.visible(tasks, "tenant-1").select("task_id", "tenant_id")


@query("p7_list_registry", "nodes", "SELECT node_id, state, gpus FROM nodes WHERE tenant_id = 'tenant-2' AND cluster_id = 12")
def _(nodes):
    return audit.list_registry(nodes, "tenant-2", 12).select("node_id", "state", "gpus")


@query(
    "g1_latest_runs", "task_runs",
    """SELECT task_id, run_key, status, epoch_us(created_at) AS created_at, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, run_key DESC, worker_id DESC) AS rank FROM task_runs) WHERE rank <= 3""",
)
def _(runs):
    return audit.latest_runs(runs, 3).select("task_id", "run_key", "status", "created_at", "rank")


@query(
    "g2_run_events", "task_events",
    """SELECT id, task_id, event, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) AS rank FROM task_events) WHERE rank <= 10""",
)
def _(events):
    return audit.run_events(events, 10).select("id", "task_id", "event", "rank")


@query(
    "g3_timeline", "task_events",
    """SELECT id, task_id, event, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at, id) AS rank FROM task_events) WHERE rank <= 10""",
)
def _(events):
    return audit.timeline(events, 10).select("id", "task_id", "event", "rank")


@query(
    "g4_operator_actions", "operator_actions",
    "SELECT id, actor, target_id, reason FROM operator_actions WHERE action_type = 'task_replay_requested' ORDER BY created_at DESC, id DESC LIMIT 100",
)
def _(actions):
    return audit.actions(actions, "task_replay_requested").select("id", "actor", "target_id", "reason")


@query(
    "g5_stale_runs", "task_runs",
    "SELECT task_id, run_key, epoch_us(created_at) AS created_at FROM task_runs WHERE status = 'running' ORDER BY created_at, run_key LIMIT 50",
)
def _(runs):
    return audit.stale_runs(runs).select("task_id", "run_key", "created_at")


@query(
    "g5_replay_queue", "task_runs",
    "SELECT task_id, run_key, epoch_us(created_at) AS created_at FROM task_runs WHERE status = 'replay_requested' ORDER BY created_at, run_key LIMIT 50",
)
def _(runs):
    return audit.stale_runs(runs, "replay_requested").select("task_id", "run_key", "created_at")


@query("g6_dead_letters", "callback_outbox", "SELECT id, task_id, attempt_count FROM callback_outbox WHERE delivery_status = 'dead_letter' ORDER BY created_at, id LIMIT 50")
def _(outbox):
    return audit.dead_letters(outbox).select("id", "task_id", "attempt_count")


@query(
    "g7_due_callbacks", "callback_outbox",
    f"""SELECT id, task_id FROM callback_outbox WHERE delivery_status = 'pending'
        AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{EVENTS_AS_OF}') ORDER BY id LIMIT 50""",
)
def _(outbox):
    return audit.due_callbacks(outbox, EVENTS_AS_OF).select("id", "task_id")


@query(
    "g9_dead_nodes", "health_checks",
    f"""SELECT entity AS node_id, epoch_us(max(ts)) AS last_seen, 'offline' AS state FROM health_checks GROUP BY entity
        HAVING max(ts) <= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14400 SECOND""",
)
def _(beats):
    return audit.dead_nodes(beats, EVENTS_AS_OF, 14400)


@query(
    "g10_stale_entries", "queue_entries",
    "SELECT capability, count(*) AS removed FROM queue_entries WHERE queue_set = 'running' AND score % 10000000000000 < 800050000000 - 300000 GROUP BY capability",
)
def _(entries):
    return audit.stale_entries(entries, 800_050_000_000)


@query(
    "g11_replay_chain", "task_runs",
    """SELECT task_id, run_key, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at, run_key, worker_id) AS rank FROM task_runs) WHERE rank <= 5""",
)
def _(runs):
    return audit.replay_chain(runs, 5).select("task_id", "run_key", "rank")


@query("g12_newest_alerts", "alerts", "SELECT id, alertname, severity FROM alerts ORDER BY starts_at DESC, id DESC LIMIT 50")
def _(alerts):
    return audit.newest_alerts(alerts).select("id", "alertname", "severity")
