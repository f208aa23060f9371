"""Queries of opstables.operators.queue."""

from pyspark.sql import functions as F

from opstables.operators import queue
from opstables.plans.registry import query

_LIMITS = """lim AS (SELECT capability, count(*) FILTER (queue_set = 'pending') AS pending, count(*) FILTER (queue_set = 'running') AS running,
       any_value(CASE WHEN max_queue_depth > 0 THEN max_queue_depth ELSE 1000 END) AS max_queue_depth,
       any_value(CASE WHEN max_concurrent > 0 THEN max_concurrent ELSE 8 END) AS max_concurrent
     FROM queue_entries LEFT JOIN queue_config USING (capability) GROUP BY capability)"""
#: The moment that the queues are looked at from: some of the entries of every size of the data are ready then, others not.
_NOW = 800_005_000_000


@query("a4_queue_snapshot", "queue_entries queue_config", f"WITH {_LIMITS} SELECT * FROM lim")
def _(entries, config):
    return queue.limits(entries, config)


@query(
    "e1_queue_positions", "queue_entries",
    "SELECT capability, task_id, row_number() OVER (PARTITION BY capability ORDER BY score, task_id) AS position FROM queue_entries WHERE queue_set = 'pending'",
)
def _(entries):
    return queue.positions(entries)


_SLOTS = f"""WITH {_LIMITS}, seen AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY score, task_id) AS r FROM queue_entries WHERE queue_set = 'pending'),
  ready AS (SELECT capability, task_id, row_number() OVER (PARTITION BY capability ORDER BY score, task_id) AS rank FROM seen WHERE r <= 50 AND score % 10000000000000 <= {_NOW})"""


@query("e2_next_ready", "queue_entries queue_config", f"{_SLOTS} SELECT capability, task_id FROM ready JOIN lim USING (capability) WHERE rank = 1 AND running < max_concurrent")
def _(entries, config):
    return queue.next_ready(entries, config, _NOW)


@query("e3_fill_slots", "queue_entries queue_config", f"{_SLOTS} SELECT capability, task_id, rank FROM ready JOIN lim USING (capability) WHERE rank <= max_concurrent - running")
def _(entries, config):
    return queue.fill_slots(entries, config, _NOW)


_ARRIVALS = "arr AS (SELECT capability, task_id, epoch_us(created_at) AS seq FROM tasks)"


def _arrivals(tasks):
    return tasks.select("capability", "task_id", F.unix_micros("created_at").alias("seq"))


@query(
    "e4_admission", "tasks queue_entries queue_config",
    f"""WITH {_LIMITS}, {_ARRIVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY seq, task_id) AS i FROM arr LEFT JOIN lim USING (capability))
        SELECT capability, task_id, coalesce(pending, 0) + i <= coalesce(max_queue_depth, 1000) AS accepted,
               CASE WHEN coalesce(pending, 0) + i <= coalesce(max_queue_depth, 1000) THEN coalesce(pending, 0) + i END AS position,
               least(coalesce(pending, 0) + i, greatest(coalesce(max_queue_depth, 1000), coalesce(pending, 0))) AS pending_count FROM n""",
)
def _(tasks, entries, config):
    return queue.admit(_arrivals(tasks), entries, config)


@query(
    "e5_slot_admission", "tasks queue_entries queue_config",
    f"""WITH {_LIMITS}, {_ARRIVALS}, n AS (SELECT *, row_number() OVER (PARTITION BY capability ORDER BY seq, task_id) AS i FROM arr LEFT JOIN lim USING (capability))
        SELECT capability, task_id AS slot_id, coalesce(running, 0) + i <= coalesce(max_concurrent, 8) AS acquired FROM n""",
)
def _(tasks, entries, config):
    return queue.admit_slots(_arrivals(tasks), entries, config)


@query(
    "e6_greedy_nodes", "nodes region",
    """WITH t AS (SELECT node_id, gpus, coalesce(CAST(sum(gpus) OVER (ORDER BY gpus DESC, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS running_gpus
                  FROM nodes WHERE state = 'idle' AND gpus > 0)
       SELECT CAST(r_regionkey AS BIGINT) AS request_id, node_id, gpus, running_gpus FROM t JOIN region ON running_gpus < 7 + 20 * r_regionkey""",
)
def _(nodes, region):
    return queue.greedy_nodes(region.selectExpr("CAST(r_regionkey AS BIGINT) AS request_id", "7 + 20 * r_regionkey AS required_gpus"), nodes)


@query(
    "e6_node_cuts", "nodes orders",
    """WITH t AS (SELECT gpus, coalesce(CAST(sum(gpus) OVER (ORDER BY gpus DESC, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS running_gpus
                  FROM nodes WHERE state = 'idle' AND gpus > 0),
            q AS (SELECT o_orderkey AS request_id, o_totalprice / 1000 - 5 AS required_gpus FROM orders)
       SELECT request_id, round(required_gpus, 6) AS required_gpus, count(gpus) AS n_nodes, CAST(coalesce(sum(gpus), 0) AS BIGINT) AS taken_gpus, coalesce(sum(gpus), 0) >= required_gpus AS met
       FROM q LEFT JOIN t ON running_gpus < required_gpus GROUP BY request_id, q.required_gpus""",
)
def _(nodes, orders):
    return queue.node_cuts(orders.selectExpr("o_orderkey AS request_id", "o_totalprice / 1000 - 5 AS required_gpus"), nodes).withColumn("required_gpus", F.round("required_gpus", 6))


@query(
    "e7_least_loaded", "nodes",
    """WITH w AS (SELECT cluster_id AS pool, node_id AS idx, gpus AS pending, count(*) OVER (PARTITION BY cluster_id) AS n FROM nodes),
            r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY pending, ((idx - 5) % n + n) % n, idx) AS k FROM w)
       SELECT pool, idx, pending FROM r WHERE k = 1""",
)
def _(nodes):
    return queue.least_loaded(nodes.selectExpr("cluster_id AS pool", "node_id AS idx", "gpus AS pending"), 5)


@query(
    "e8_worker_trips", "health_checks",
    """SELECT entity AS worker, id, epoch_us(ts) AS at_us,
              count(*) OVER (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) >= 2 AS tripped
       FROM health_checks WHERE NOT ok""",
)
def _(checks):
    return queue.tripped(checks.where("NOT ok").withColumnRenamed("entity", "worker"), 86400, 2)


@query(
    "a5_queue_stats", "queue_entries task_events",
    """WITH s AS (SELECT capability, count(*) FILTER (queue_set = 'pending') AS pending, count(*) FILTER (queue_set = 'running') AS running FROM queue_entries GROUP BY 1),
            t AS (SELECT concat('cap-', CAST(task_id % 9 AS VARCHAR)) AS capability, count(*) FILTER (event = 'enqueue') AS total_enqueued, count(*) FILTER (event = 'start') AS total_dequeued,
                         count(*) FILTER (event = 'complete') AS total_completed, count(*) FILTER (event = 'fail') AS total_failed FROM task_events GROUP BY 1)
       SELECT capability, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running, coalesce(total_enqueued, 0) AS total_enqueued, coalesce(total_dequeued, 0) AS total_dequeued,
              coalesce(total_completed, 0) AS total_completed, coalesce(total_failed, 0) AS total_failed FROM s FULL JOIN t USING (capability)""",
)
def _(entries, events):
    return queue.queue_stats(entries, events.withColumn("capability", F.expr("concat('cap-', task_id % 9)")))


@query("a14_capabilities", "queue_entries", "SELECT DISTINCT capability FROM queue_entries ORDER BY 1 LIMIT 2000")
def _(entries):
    return queue.capabilities(entries)


@query("u1_visible_capabilities", "queue_entries tasks", "SELECT capability FROM queue_entries INTERSECT SELECT capability FROM tasks WHERE tenant_id = 'tenant-4'")
def _(entries, tasks):
    return queue.visible_caps(entries, tasks.where("tenant_id = 'tenant-4'"))


@query(
    "u3_start_tasks", "queue_entries",
    """SELECT capability, task_id, CASE WHEN queue_set = 'pending' AND task_id % 10 = 0 THEN 'running' ELSE queue_set END AS queue_set,
              CASE WHEN queue_set = 'pending' AND task_id % 10 = 0 THEN 800005000000 ELSE score END AS score FROM queue_entries""",
)
def _(entries):
    return queue.start_tasks(entries, entries.where("task_id % 10 = 0"), _NOW)


@query(
    "u4_cancel_entries", "tasks queue_entries",
    """SELECT t.capability, t.task_id, coalesce(min(queue_set), 'absent') AS removed_from FROM tasks t LEFT JOIN queue_entries q ON q.task_id = t.task_id AND q.capability = t.capability GROUP BY 1, 2""",
)
def _(tasks, entries):
    return queue.cancel_entries(entries, tasks.select("capability", "task_id"))


@query(
    "u5_cancel_verdict", "tasks",
    """SELECT task_id, status, status = 'queued' AS cancelled,
              CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 'already ended' WHEN status <> 'queued' THEN 'illegal transition' ELSE 'ok' END AS reason FROM tasks""",
)
def _(tasks):
    return queue.cancel_verdict(tasks)


@query(
    "u6_finish_entries", "queue_entries",
    """WITH f AS (SELECT capability, task_id, CASE task_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'release' END AS outcome FROM queue_entries WHERE queue_set = 'running' AND task_id % 4 = 0),
            l AS (SELECT capability, count(*) AS still_running FROM queue_entries e WHERE queue_set = 'running' AND task_id % 4 <> 0 GROUP BY 1),
            b AS (SELECT capability, count(*) FILTER (outcome = 'complete') AS completed, count(*) FILTER (outcome = 'fail') AS failed FROM f GROUP BY 1)
       SELECT capability, coalesce(still_running, 0) AS still_running, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed FROM l FULL JOIN b USING (capability)""",
)
def _(entries):
    done = entries.where("queue_set = 'running' AND task_id % 4 = 0").selectExpr("capability", "task_id", "CASE task_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'fail' ELSE 'release' END AS outcome")
    return queue.finish_entries(entries, done)


@query(
    "u7_drop_tenants", "customer tenants",
    """SELECT sha256(c_name) AS api_key, concat('tenant-', CAST(c_custkey % 10 AS VARCHAR)) AS tenant_id FROM customer
       WHERE concat('tenant-', CAST(c_custkey % 10 AS VARCHAR)) NOT IN (SELECT tenant_id FROM tenants WHERE status = 'suspended')""",
)
def _(customer, tenants):
    keys = customer.selectExpr("sha2(c_name, 256) AS api_key", "concat('tenant-', c_custkey % 10) AS tenant_id")
    return queue.drop_tenants(keys, tenants.where("status = 'suspended'"))
