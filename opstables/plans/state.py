"""Queries of opstables.operators.fsm."""

from pyspark.sql import functions as F

from opstables.operators import fsm
from opstables.plans import recursion
from opstables.plans.registry import query

_STREAK = """r AS (SELECT *, CASE WHEN ok = lag(ok) OVER (PARTITION BY entity ORDER BY ts, id) THEN 0 ELSE 1 END AS f FROM health_checks),
  i AS (SELECT *, sum(f) OVER (PARTITION BY entity ORDER BY ts, id) AS g FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY ts, id) AS k FROM i),
  s AS (SELECT *, CASE WHEN ok THEN k ELSE 0 END AS consec_ok, CASE WHEN ok THEN 0 ELSE k END AS consec_fail FROM n)"""


HEALTH_SQL = f"""WITH {_STREAK}, e AS (SELECT *, sum(CAST(consec_ok = 2 AS INT)) OVER (PARTITION BY entity ORDER BY ts, id) AS ep FROM s),
        w AS (SELECT *, max(consec_fail) OVER (PARTITION BY entity, ep ORDER BY ts, id) AS worst FROM e)
        SELECT entity, id, CASE WHEN worst >= 3 THEN 'unhealthy' WHEN worst >= 2 THEN 'degraded' ELSE 'healthy' END AS status FROM w"""


@query("e9_streaks", "health_checks", f"WITH {_STREAK} SELECT entity, id, consec_ok, consec_fail FROM s")
def _(checks):
    return fsm.streaks(checks, "entity", "ok", ["ts", "id"]).select("entity", "id", "consec_ok", "consec_fail")


@query(
    "e10_health_state", "health_checks",
    HEALTH_SQL,
)
def _(checks):
    return fsm.health_state(checks, "entity", "ok", ["ts", "id"]).select("entity", "id", "status")


@query(
    "p8_usable_capabilities", "health_checks",
    f"""WITH {_STREAK}, e AS (SELECT *, sum(CAST(consec_ok = 2 AS INT)) OVER (PARTITION BY entity ORDER BY ts, id) AS ep FROM s),
        w AS (SELECT *, max(consec_fail) OVER (PARTITION BY entity, ep ORDER BY ts, id) AS worst, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, id DESC) AS last FROM e)
        SELECT entity, CASE WHEN worst >= 2 THEN 'degraded' ELSE 'healthy' END AS status FROM w WHERE last = 1 AND worst < 3""",
)
def _(checks):
    from opstables.operators.audit import usable_capabilities

    states = fsm.health_state(checks, "entity", "ok", ["ts", "id"])
    return usable_capabilities(fsm.latest(states, "entity", ["ts", "id"])).select("entity", "status")


@query("e11_breaker_timeline", "health_checks", recursion.breaker(2, 86400))
def _(checks):
    return fsm.breaker_timeline(checks, "entity", threshold=2, open_s=86400)


@query("e12_client_breaker_timeline", "health_checks", recursion.client_breaker(2, 43200))
def _(checks):
    return fsm.client_breaker_timeline(checks, "entity", threshold=2, reset_s=43200)


@query("e13_rate_limit", "health_checks", recursion.limiter(86400, 2))
def _(checks):
    return fsm.rate_limit(checks, "entity", window=86400, most=2)


@query("e14_concurrency_timeline", "health_checks", recursion.concurrency())
def _(checks):
    return fsm.concurrency_timeline(checks, "entity")


@query("e15_replay_fsm", "task_events", recursion.machine(*recursion.TASKS))
def _(events):
    return fsm.replay_fsm(events, "task_id")


@query(
    "e15_single_step", "tasks",
    """SELECT task_id, CASE WHEN status = 'queued' AND e = 'start' THEN 'running' WHEN status = 'queued' AND e = 'cancel' THEN 'cancelled' WHEN status = 'scheduled' AND e = 'enqueue' THEN 'queued'
         WHEN status = 'running' AND e = 'complete' THEN 'completed' WHEN status = 'running' AND e = 'requeue' THEN 'queued' END AS next_state
       FROM (SELECT *, ['start', 'cancel', 'enqueue', 'complete', 'requeue'][task_id % 5 + 1] AS e FROM tasks)""",
)
def _(tasks):
    event = F.element_at(F.array(*map(F.lit, ("start", "cancel", "enqueue", "complete", "requeue"))), (F.col("task_id") % 5 + 1).cast("int"))
    return fsm.transition(tasks.withColumn("event", event), "status", "event").select("task_id", "next_state")


@query("e16_node_fsm", "task_events", recursion.machine(*recursion.NODES))
def _(events):
    return fsm.replay_fsm(events.withColumn("event", F.expr(recursion.NODE_EVENT)), "task_id", fsm.NODE_TABLE, "idle")


@query("e20_latest", "health_checks", "SELECT entity, id, ok FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, id DESC) AS r FROM health_checks) WHERE r = 1")
def _(checks):
    return fsm.latest(checks, "entity", ["ts", "id"]).select("entity", "id", "ok")


@query(
    "e21_durations", "task_events",
    """WITH s AS (SELECT task_id, min(created_at) AS a FROM task_events WHERE event = 'enqueue' GROUP BY 1),
            e AS (SELECT t.task_id, a, created_at, event, row_number() OVER (PARTITION BY t.task_id ORDER BY created_at, id) AS r FROM task_events t JOIN s USING (task_id) WHERE event IN ('complete', 'fail') AND created_at > a)
       SELECT task_id, (epoch_us(created_at) - epoch_us(a)) / 1000000.0 AS seconds, event AS outcome FROM e WHERE r = 1""",
)
def _(events):
    return fsm.durations(events, "task_id", "enqueue", ("complete", "fail"))


@query("e22_scale_advice", "health_checks", recursion.scale(7200))
def _(checks):
    snapshots = checks.groupBy("capability", F.expr("unix_seconds(ts) DIV 3600 * 3600").alias("t")).agg((F.avg("duration_seconds") / 100).alias("utilization"))
    return fsm.scale_advice(snapshots, "capability", cooldown=7200)


@query(
    "e23_coalesce_ticks", "health_checks",
    """WITH t AS (SELECT entity AS schedule_id, epoch_us(ts) // 1000000 AS t, (epoch_us(ts) // 1000000 + 3599) // 3600 * 3600 AS poll_at FROM health_checks)
       SELECT schedule_id, poll_at, max(t) AS fire_at, count(*) - 1 AS missed FROM t GROUP BY ALL""",
)
def _(checks):
    ticks = checks.select(F.col("entity").alias("schedule_id"), F.unix_seconds("ts").alias("t"))
    polls = checks.select(F.expr("(unix_seconds(ts) + 3599) DIV 3600 * 3600").alias("poll_at")).distinct()
    return fsm.coalesce_ticks(ticks, polls, 3600)


@query(
    "e23_coalesce_ticks_all", "health_checks",
    """WITH t AS (SELECT entity AS schedule_id, epoch_us(ts) // 1000000 AS t FROM health_checks), p AS (SELECT DISTINCT (t + 3599) // 3600 * 3600 AS poll_at FROM t WHERE (t + 3599) // 3600 % 2 = 0)
       SELECT schedule_id, poll_at, max(t) AS fire_at, count(*) - 1 AS missed FROM t ASOF JOIN p ON t.t <= p.poll_at GROUP BY ALL""",
)
def _(checks):
    ticks = checks.select(F.col("entity").alias("schedule_id"), F.unix_seconds("ts").alias("t"))
    polls = checks.select(F.expr("(unix_seconds(ts) + 3599) DIV 3600 * 3600").alias("poll_at")).distinct().where("poll_at % 7200 = 0")
    return fsm.coalesce_to_polls(ticks, polls, 3600)
