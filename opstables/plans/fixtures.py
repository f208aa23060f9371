"""The operational tables as views over the given ones, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The moments that the queries look from, for tables made of orders and of events.
TASKS_AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

_BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "tasks": """
SELECT o_orderkey AS task_id, concat('tenant-', CAST(o_custkey % 10 AS VARCHAR(20))) AS tenant_id,
       concat('cap-', CAST(o_custkey % 8 AS VARCHAR(20))) AS capability,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 9 = 0 THEN 'scheduled' WHEN o_orderstatus = 'O' THEN 'queued'
            WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 5 = 0 THEN 'failed'
            WHEN o_orderkey % 11 = 0 THEN 'cancelled' ELSE 'completed' END AS status,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority_rank, CAST(o_orderkey % 5 AS INT) AS attempt,
       CAST(o_custkey % 4 AS INT) AS max_retries,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('http://cb/', CAST(o_orderkey AS VARCHAR(20))) END AS callback_url,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('key-', CAST(o_custkey % 50 AS VARCHAR(20))) END AS idempotency_key,
       CAST(o_orderkey % 7 * 600 AS INT) AS timeout_seconds,
       CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'oops' WHEN 2 THEN '[]' ELSE concat('{"n": "', CAST(o_orderkey AS VARCHAR(20)), '"}') END AS input_data,
       o_totalprice AS cost, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM orders""",
    "task_cache": """
SELECT task_id, tenant_id, capability, status, priority_rank, attempt, max_retries, callback_url, created_at
FROM (SELECT o_orderkey AS task_id, concat('tenant-', CAST(o_custkey % 10 AS VARCHAR(20))) AS tenant_id,
       concat('cap-', CAST(o_custkey % 8 AS VARCHAR(20))) AS capability,
       CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS status,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority_rank, CAST(o_orderkey % 5 AS INT) AS attempt, CAST(o_custkey % 4 AS INT) AS max_retries,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'http://cb' END AS callback_url, CAST(o_orderdate AS TIMESTAMP) AS created_at
      FROM orders) t
WHERE task_id % 7 <> 0""",
    "leases": """
SELECT o_orderkey AS task_id, concat('worker-', CAST(o_custkey % 16 AS VARCHAR(20))) AS owner
FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 <> 0""",
    "queue_entries": """
SELECT concat('cap-', CAST(o_custkey % 8 AS VARCHAR(20))) AS capability, o_orderkey AS task_id,
       CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS queue_set,
       CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10000000000000 + 800000000000 + (o_orderkey % 100000) * 1000 AS score
FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 13 <> 0""",
    "queue_config": """
SELECT concat('cap-', CAST(n_nationkey AS VARCHAR(20))) AS capability, 100 * (1 + n_nationkey) AS max_queue_depth,
       CASE WHEN n_nationkey % 2 = 1 THEN 10000000 * n_nationkey ELSE 60 * n_nationkey END AS max_concurrent
FROM nation WHERE n_nationkey < 6""",
    "task_runs": """
SELECT l_orderkey AS task_id,
       concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS run_key,
       CAST(l_linenumber AS INT) AS attempt, concat('worker-', CAST(l_suppkey AS VARCHAR(20))) AS worker_id,
       CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'replay_requested'
            WHEN l_linestatus = 'O' THEN 'running' ELSE 'completed' END AS status,
       CAST(l_shipdate AS TIMESTAMP) AS created_at
FROM lineitem""",
    "task_events": """
SELECT event_id AS id, user_id AS task_id,
       CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete'
            WHEN 'error' THEN 'fail' ELSE 'requeue' END AS event,
       props AS event_payload, CAST(ts AS TIMESTAMP) AS created_at
FROM events""",
    "health_checks": """
SELECT event_id AS id, user_id AS entity, concat('cap-', CAST(user_id % 8 AS VARCHAR(20))) AS capability,
       event_type <> 'error' AS ok, value AS duration_seconds, CAST(ts AS TIMESTAMP) AS ts
FROM events""",
    "callback_outbox": """
SELECT event_id AS id, user_id AS task_id, concat('tenant-', CAST(user_id % 10 AS VARCHAR(20))) AS tenant_id,
       CASE WHEN event_id % 9 = 8 THEN 'dead_letter' WHEN event_id % 4 = 0 THEN 'delivered'
            WHEN event_id % 4 = 1 THEN 'failed' ELSE 'pending' END AS delivery_status,
       CAST(event_id % 9 AS INT) AS attempt_count,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS next_attempt_at,
       CAST(ts AS TIMESTAMP) AS created_at
FROM events WHERE event_type IN ('purchase', 'signup', 'error')""",
    "operator_actions": """
SELECT event_id AS id, concat('op-', CAST(event_id % 7 AS VARCHAR(20))) AS actor,
       CASE WHEN event_id % 5 < 3 THEN 'task_replay_requested' WHEN event_id % 5 = 3 THEN 'dead_letter_acknowledged'
            ELSE 'force_lease_eviction' END AS action_type,
       user_id AS target_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'ops' END AS reason,
       CASE event_id % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' ELSE 'viewer' END AS actor_role,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_event,
       CAST(ts AS TIMESTAMP) AS created_at
FROM events WHERE event_type = 'click'""",
    "nodes": """
SELECT s_suppkey AS node_id, concat('tenant-', CAST(s_nationkey % 10 AS VARCHAR(20))) AS tenant_id, s_nationkey AS cluster_id,
       CASE s_suppkey % 4 WHEN 0 THEN 'joined' WHEN 1 THEN 'draining' ELSE 'idle' END AS state,
       CAST(s_suppkey % 9 AS INT) AS gpus, CAST(8 * (1 + s_suppkey % 8) AS INT) AS cpus
FROM supplier""",
    "clusters": """
SELECT n_nationkey AS cluster_id, n_regionkey AS region_id, CASE WHEN n_nationkey % 6 = 5 THEN 'offline' ELSE 'active' END AS status,
       CAST(n_nationkey % 9 AS INT) AS available_gpus, CAST(16 * (1 + n_nationkey % 5) AS INT) AS available_cpus,
       CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('tenant-', CAST(n_nationkey % 10 AS VARCHAR(20))) END AS tenant_id
FROM nation""",
    "tenants": """
SELECT concat('tenant-', CAST(n_nationkey AS VARCHAR(20))) AS tenant_id, CASE WHEN n_nationkey % 4 = 3 THEN 'suspended' ELSE 'active' END AS status,
       CAST(n_nationkey % 5 * 10 AS BIGINT) AS max_gpus, CAST(n_nationkey % 4 * 500 AS BIGINT) AS max_tasks, CAST(n_nationkey % 3 * 40 AS BIGINT) AS max_actors
FROM nation WHERE n_nationkey < 10""",
    "dag_steps": """
SELECT p_partkey AS step, CAST(floor(p_partkey / 2) AS BIGINT) AS depends_on FROM part WHERE p_partkey > 0
UNION
SELECT p_partkey AS step, CAST(floor(p_partkey / 3) AS BIGINT) AS depends_on FROM part WHERE p_partkey > 0""",
    "chunk_stream": """
SELECT conv_id AS stream_id, turn AS seq, CAST(length(text) AS BIGINT) AS len, turn % 5 = 4 AS is_done, role = 'system' AS is_error
FROM conversations""",
    "alerts": """
SELECT event_id AS id, CASE WHEN event_id % 6 = 0 THEN 'ServiceDown' ELSE concat('rule-', CAST(event_id % 6 AS VARCHAR(20))) END AS alertname,
       CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'info' ELSE 'warning' END AS severity,
       CASE WHEN user_id % 2 = 0 THEN 'task-api' ELSE 'ops-api' END AS service, CAST(user_id AS VARCHAR(20)) AS fingerprint,
       CASE WHEN value < 50 THEN 'resolved' ELSE 'firing' END AS status, CAST(ts AS TIMESTAMP) AS starts_at
FROM events""",
    "schedules": """
SELECT c_custkey AS schedule_id, concat('tenant-', CAST(c_custkey % 10 AS VARCHAR(20))) AS tenant_id, c_custkey % 3 <> 0 AS enabled,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'soon'
            ELSE concat('2024-01-', CASE WHEN c_custkey % 28 < 9 THEN '0' ELSE '' END, CAST(1 + c_custkey % 28 AS VARCHAR(20)), 'T06:00:00') END AS next_fire_at
FROM customer""",
}


def _on(spark_dir: str | None, sql: str) -> str:
    if spark_dir is None:
        return sql
    sql = re.sub(rf"\bFROM ({'|'.join(_BASE)})\b", lambda m: f"FROM parquet.`{spark_dir}/{m[1]}.parquet`", sql)
    return sql.replace("VARCHAR(20)", "STRING")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the given tables."""
    if name in VIEWS:
        return spark.sql(_on(sf_dir, VIEWS[name]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(names: tuple[str, ...], sql: str) -> str:
    """DuckDB SQL with the views it needs in front."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in names if n in VIEWS]
    if not parts:
        return sql
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if body[:5].upper() == "WITH ":
        body = body[14:] if recursive else body[4:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}, {body.strip()}"
    return f"WITH {', '.join(parts)} {body}"
