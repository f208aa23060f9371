"""Lists, details and newest-first reports over tasks, runs, events, actions and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _newest(time: str, *ties: str) -> list[Column]:
    return [F.col(time).desc(), *(F.col(t).desc() for t in ties)]


def list_tasks(tasks: DataFrame, tenant: str, admin: bool = False, status: str | None = None, capability: str | None = None) -> DataFrame:
    """An admin sees all tenants; status and type are optional."""
    for on, column, value in ((not admin, "tenant_id", tenant), (status is not None, "status", status), (capability is not None, "capability", capability)):
        if on:
            tasks = tasks.where(F.col(column) == value)
    return tasks


def page(df: DataFrame, key: str, cursor: object, n: int) -> DataFrame:
    """N rows after the cursor by key; next_cursor is the last kept key if more rows follow."""
    if not 1 <= n <= 500:
        raise ValueError("a page has 1 to 500 rows")
    after = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    window = Window.orderBy(key)
    rows = after.orderBy(key).limit(n + 1).withColumns({"_at": F.row_number().over(window), "_n": F.count("*").over(Window.partitionBy())})
    kept = rows.where(F.col("_at") <= n)
    return kept.withColumn("next_cursor", F.when(F.col("_n") > n, F.max(key).over(Window.partitionBy()))).drop("_at", "_n")


def json_map(raw: Column) -> Column:
    """JSON text as a map; null, malformed text and an empty list become an empty map."""
    return F.coalesce(F.when(F.trim(raw) == "[]", None).otherwise(F.from_json(raw, "map<string,string>")), F.create_map().cast("map<string,string>"))


def task_info(tasks: DataFrame) -> DataFrame:
    """Details, with a stored 0 of timeout or retries read as the default."""
    def default(c: str, value: int) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) == 0), value).otherwise(F.col(c)).alias(c)

    return tasks.select("task_id", "tenant_id", "status", json_map(F.col("input_data")).alias("input"), default("timeout_seconds", 3600), default("max_retries", 3))


def task_summary(tasks: DataFrame) -> DataFrame:
    """Without the large columns."""
    return tasks.select("task_id", "tenant_id", "capability", "status", "priority_rank", "created_at")


def task_results(tasks: DataFrame) -> DataFrame:
    """P5: only ended tasks have results."""
    ended = F.col("status").isin("completed", "failed")
    return tasks.select("task_id", "status", ended.alias("available"), F.when(~ended, "not yet available").alias("message"))


def visible(df: DataFrame, tenant: str, admin: bool = False) -> DataFrame:
    """P6"""
    return df if admin else df.where(F.col("tenant_id") == tenant)


def list_registry(df: DataFrame, tenant: str | None = None, cluster: int | None = None) -> DataFrame:
    """P7"""
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    return df if cluster is None else df.where(F.col("cluster_id") == cluster)


def usable_capabilities(health: DataFrame) -> DataFrame:
    """P8"""
    return health.where("status <> 'unhealthy'")


def latest_runs(runs: DataFrame, k: int = 100) -> DataFrame:
    """G1: of each task the k newest runs."""
    return top_per_key(runs, ["task_id"], _newest("created_at", "run_key", "worker_id"), k)


def run_events(events: DataFrame, k: int = 100) -> DataFrame:
    """Of each task the k newest events."""
    return top_per_key(events, ["task_id"], _newest("created_at", "id"), k)


def timeline(events: DataFrame, k: int = 100) -> DataFrame:
    """Of each task the k oldest events."""
    return top_per_key(events, ["task_id"], [F.col("created_at"), F.col("id")], k)


def actions(df: DataFrame, action_type: str | None = None, target_id: int | None = None, k: int = 100) -> DataFrame:
    """G4"""
    for c, v in (("action_type", action_type), ("target_id", target_id)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(*_newest("created_at", "id")).limit(k)


def stale_runs(runs: DataFrame, status: str = "running", k: int = 50) -> DataFrame:
    """The oldest runs of a status; the replay queue is status replay_requested."""
    return runs.where(F.col("status") == status).orderBy("created_at", "run_key").limit(k)


def dead_letters(outbox: DataFrame, k: int = 50) -> DataFrame:
    """Oldest first."""
    return outbox.where("delivery_status = 'dead_letter'").orderBy("created_at", "id").limit(k)


def due_callbacks(outbox: DataFrame, as_of: str, k: int = 50) -> DataFrame:
    """G7"""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(as_of).cast("timestamp"))
    return outbox.where((F.col("delivery_status") == "pending") & due).orderBy("id").limit(k)


def dead_nodes(heartbeats: DataFrame, as_of: str, timeout: int = 60) -> DataFrame:
    """Nodes whose last heartbeat is timeout seconds old or older."""
    last = heartbeats.groupBy("entity").agg(F.max("ts").alias("last_seen"))
    return last.where(F.col("last_seen") <= F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(timeout))).select(F.col("entity").alias("node_id"), "last_seen", F.lit("offline").alias("state"))


def stale_entries(entries: DataFrame, as_of_ms: int, max_age: int = 300) -> DataFrame:
    """Removed running entries per capability, by the time in their score."""
    old = entries.where((F.col("queue_set") == "running") & (F.col("score") % 10**13 < as_of_ms - 1000 * max_age))
    return old.groupBy("capability").agg(F.count("*").alias("removed"))


def replay_chain(runs: DataFrame, k: int = 50) -> DataFrame:
    """Of each task the k oldest runs."""
    return top_per_key(runs, ["task_id"], [F.col("created_at"), F.col("run_key"), F.col("worker_id")], k)


def newest_alerts(alerts: DataFrame, k: int = 50) -> DataFrame:
    """G12"""
    return alerts.orderBy(*_newest("starts_at", "id")).limit(k)
