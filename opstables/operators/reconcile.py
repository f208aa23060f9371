"""Comparison of the durable tables with caches, queues and leases, and what to do about each difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from opstables.functions import scalars
from opstables.operators.queue import limits, positions

ACTIVE = ("queued", "running", "scheduled")
STATUSES = ("pending", "delivered", "failed", "dead_letter")


def _age_seconds(time: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / 1e6


def cache_rebuild(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """Durable tasks without a cache entry, with the payload to cache."""
    def default(c: str, value: int) -> Column:
        return F.when(F.col(c).isNull() | (F.col(c) == 0), value).otherwise(F.col(c)).alias(c)

    missing = tasks.join(cache, "task_id", "left_anti")
    payload = F.struct(
        "task_id", F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "status", F.coalesce("capability", F.lit("")).alias("capability"),
        F.coalesce("callback_url", F.lit("")).alias("callback_url"), default("timeout_seconds", 3600), default("max_retries", 3), F.coalesce("attempt", F.lit(0)).alias("attempt"),
    )
    return missing.select("task_id", F.to_json(payload).alias("payload"))


def queue_restore(tasks: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """Queued and scheduled tasks that no queue holds, with their new score."""
    waiting = tasks.where(F.col("status").isin("queued", "scheduled") & (F.col("capability") != ""))
    lost = waiting.join(entries, ["capability", "task_id"], "left_anti")
    return lost.select("capability", "task_id", scalars.score(F.col("priority_rank"), F.lit(as_of_ms)).alias("score"))


#: The states that a task ends in; the record by which a lost task is compensated.
ENDED = ("completed", "failed", "cancelled")
TX_PREFIX, TX_OPERATION, TX_STATUS, TX_ERROR = "reconciler-", "create_task", "failed", "detected by reconciler phase1"


def missing_durable(cache: DataFrame, tasks: DataFrame) -> DataFrame:
    """Ended tasks (status in any case) that only the cache knows: the durable rows to add, and each one's compensation record.

    output_data: the cache's output (a text, map, list or struct; if it has such a column) as JSON, null if it is empty.  The record (tx_) says that the durable side is written and the cache's isn't.
    """
    ended = cache.where(F.lower("status").isin(*ENDED)).join(tasks.select("task_id").where("task_id IS NOT NULL").distinct(), "task_id", "left_anti").where("task_id IS NOT NULL")
    output: Column = F.lit(None).cast("string")
    if "output" in cache.columns:
        alone = F.to_json(F.array("output"))  # a text isn't JSON by itself
        output = F.substring(alone, F.lit(2), F.length(alone) - 2) if cache.schema["output"].dataType == StringType() else F.to_json("output")
        output = F.when(~output.isin('""', "{}", "[]", "null"), output)
    return ended.select(
        "task_id", F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "status", output.alias("output_data"),
        F.concat(F.lit(TX_PREFIX), F.left(F.col("task_id").cast("string"), F.lit(8))).alias("tx_id"), F.lit(TX_OPERATION).alias("tx_operation"), F.lit(TX_STATUS).alias("tx_status"),
        F.lit(True).alias("tx_durable_written"), F.lit(False).alias("tx_cache_written"), F.lit(TX_ERROR).alias("tx_error"),
    )


def stuck_tasks(cache: DataFrame, leases: DataFrame, recent: DataFrame, as_of: str, max_age: int = 300, cap: int | None = 20) -> DataFrame:
    """C4: queued or running, without a lease, old enough (or of unknown age) and not seen to just now; at most cap."""
    old = F.col("created_at").isNull() | (_age_seconds(F.col("created_at"), as_of) >= max_age)
    found = cache.where(F.col("status").isin("running", "queued") & old).join(leases, "task_id", "left_anti").join(recent, "task_id", "left_anti")
    return found if cap is None else found.orderBy("task_id").limit(cap)


def stuck_disposition(stuck: DataFrame) -> DataFrame:
    """Requeue with a growing delay while attempts are left, else fail."""
    again = F.coalesce("attempt", F.lit(0)) < F.coalesce("max_retries", F.lit(0))
    return stuck.select(
        "task_id",
        "capability",
        F.when(again, "requeue").otherwise("fail").alias("action"),
        F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
        F.when(again, scalars.requeue_delay_ms(F.col("attempt"))).alias("delay_ms"),
        F.when(again, F.coalesce("priority_rank", F.lit(3))).alias("priority_rank"),
        F.when(~again, "stuck_without_lease").alias("reason"),
    )


def lost_callbacks(cache: DataFrame, done: DataFrame, queued: DataFrame, as_of: str) -> DataFrame:
    """Ended tasks with a URL whose callback is neither done nor queued: due in 10 s."""
    ended = cache.where(F.col("status").isin("completed", "failed") & (F.coalesce("callback_url", F.lit("")) != ""))
    lost = ended.join(done, "task_id", "left_anti").join(queued, "task_id", "left_anti")
    due = (F.unix_micros(F.lit(as_of).cast("timestamp")) + 10_000_000).alias("next_retry_us")
    return lost.select("task_id", "callback_url", F.to_json(F.struct("task_id", "status")).alias("payload"), F.lit(1).alias("attempt"), due)


def active_missing(tasks: DataFrame, cache: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Active tasks of the last hours that the cache lacks; the rebuilt rows have priority 3."""
    recent = tasks.where(F.col("status").isin(*ACTIVE) & (_age_seconds(F.col("created_at"), as_of) <= 3600 * hours))
    return recent.join(cache, "task_id", "left_anti").select("task_id", "tenant_id", "status", "capability", F.lit(3).alias("priority_rank"))


def repair_tx(tx_log: DataFrame, tasks: DataFrame, cache: DataFrame, max_retries: int = 3) -> DataFrame:
    """What becomes of unfinished transactions."""
    known = tasks.select("task_id", F.col("status").alias("durable_status"), "tenant_id", "capability")
    open_tx = tx_log.where(F.col("status").isin("pending_redis", "failed")).select("tx_id", "task_id", "operation", "retry_count")
    rows = open_tx.join(known, "task_id", "left").join(cache.select("task_id", F.lit(True).alias("cached")), "task_id", "left")
    gone = (F.col("retry_count") >= max_retries) | F.col("durable_status").isNull() | ~F.col("operation").isin("create_task", "update_status")
    rebuilt = F.when(F.col("operation") == "create_task", F.to_json(F.struct("task_id", F.col("durable_status").alias("status"), F.lit(3).alias("priority_rank"))))
    refreshed = F.when((F.col("operation") == "update_status") & F.col("cached"), F.to_json(F.struct(F.col("durable_status").alias("status"))))
    return rows.select("tx_id", "task_id", F.when(gone, "expired").otherwise("committed").alias("outcome"), F.when(~gone, F.coalesce(rebuilt, refreshed)).alias("payload"))


def submit(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """A request (request_id, tenant_id, idempotency_key) with a known tenant and key gets the earliest task of that key; without a key it is new.

    Of requests that bring the same new key, the one of the least request_id makes the task and the others reuse it.
    """
    first = tasks.where("idempotency_key IS NOT NULL").groupBy("tenant_id", "idempotency_key").agg(F.min_by("task_id", F.struct("created_at", "task_id")).alias("known_id"))
    new = requests.where("idempotency_key IS NOT NULL").groupBy("tenant_id", "idempotency_key").agg(F.min("request_id").alias("maker"))
    found = requests.join(first, ["tenant_id", "idempotency_key"], "left").join(new, ["tenant_id", "idempotency_key"], "left")
    reused = F.col("known_id").isNotNull() | F.coalesce(F.col("request_id") > F.col("maker"), F.lit(False))
    return found.select("request_id", F.coalesce(F.col("known_id").cast("string"), scalars.cron_task_id(F.col("idempotency_key"))).alias("task_id"), reused.alias("idempotent_reused"))


def explain(tasks: DataFrame, leases: DataFrame, cache: DataFrame) -> DataFrame:
    """Why a task may need recovery."""
    rows = tasks.select("task_id", "status").join(leases.select("task_id", F.lit(True).alias("_l")), "task_id", "left").join(cache.select("task_id", F.lit(True).alias("_c")), "task_id", "left")
    lease, running = F.col("_l").isNotNull(), F.col("status") == "running"
    reasons = F.array_compact(F.array(F.when(~lease, "lease_missing"), F.when(running & ~lease, "running_without_lease")))
    action = F.when(running & ~lease, "repair").when(F.col("status").isin("failed", "completed"), "check_callback").otherwise("inspect")
    shown = F.when(F.size(reasons) == 0, F.array(F.lit("consistent"))).otherwise(reasons)
    return rows.select("task_id", lease.alias("lease"), F.col("_c").isNotNull().alias("cached"), F.lit(True).alias("durable"), action.alias("recommended_action"), shown.alias("reasons"))


def task_debug(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """C17: durable facts with the task's place in the queues."""
    rows = tasks.select("task_id", "status").join(entries.select("task_id", "queue_set", "capability"), "task_id", "left").join(positions(entries), ["capability", "task_id"], "left")
    pending = F.concat(F.lit("wait in "), F.col("capability"), F.lit(" at place "), F.col("position").cast("string"))
    running = F.concat(F.lit("runs in "), F.col("capability"))
    return rows.select("task_id", "status", "queue_set", "capability", "position", F.when(F.col("queue_set") == "pending", pending).when(F.col("queue_set") == "running", running).alias("recommendation"))


def overview(entries: DataFrame, config: DataFrame, breaker: DataFrame, tenant_caps: DataFrame | None = None, reachable: bool = True) -> DataFrame:
    """Each capability's queue, limits, breaker state and utilisation, beside the totals and the overall status.

    tenant_caps: the capabilities to show (all without it); reachable: whether the store answers, else the status is critical.
    """
    seen = entries if tenant_caps is None else entries.join(tenant_caps.select("capability").distinct(), "capability", "left_semi")
    rows = limits(seen, config).join(breaker, "capability", "left")
    use = F.when(F.col("max_concurrent") > 0, F.round(F.col("running") / F.col("max_concurrent"), 2)).otherwise(0.0)
    per = rows.select("capability", "pending", "running", "max_concurrent", F.coalesce("circuit_state", F.lit("closed")).alias("circuit_state"), use.alias("utilization"))
    status = F.when(~F.lit(reachable), "critical").when(F.count_if(F.col("circuit_state") == "open") > 0, "degraded").otherwise("ok")
    total = per.agg(F.sum("pending").alias("total_pending"), F.sum("running").alias("total_running"), status.alias("overall_status"))
    return per.crossJoin(F.broadcast(total))  # one row


def replay_effects(requests: DataFrame) -> DataFrame:
    """The rows that replays add to runs, actions and events, marked by their table."""
    run = F.concat(F.lit("replay-"), F.col("id").cast("string"))
    tables = F.array(
        F.struct(F.lit("run").alias("table_name"), run.alias("key"), F.lit("replay_requested").alias("detail")),
        F.struct(F.lit("action").alias("table_name"), F.col("actor").alias("key"), F.lit("task_replay_requested").alias("detail")),
        F.struct(F.lit("event").alias("table_name"), run.alias("key"), F.lit("replay").alias("detail")),
    )
    return requests.select("id", F.col("target_id").alias("task_id"), F.inline(tables))


def dead_letter_ops(outbox: DataFrame, commands: DataFrame) -> DataFrame:
    """C20: acknowledge keeps a dead letter, with its actor; replay makes it pending again at once; unknown ids fail."""
    rows = commands.join(outbox.select("id", "delivery_status", "attempt_count"), "id", "left")
    known = F.col("delivery_status").isNotNull()
    status = F.when(known & (F.col("command") == "replay"), "pending").otherwise(F.col("delivery_status"))
    return rows.select("id", "command", known.alias("ok"), status.alias("delivery_status"), F.when(known & (F.col("command") == "acknowledge"), F.col("actor")).alias("acknowledged_by"))


def callback_summary(outbox: DataFrame) -> DataFrame:
    """A1: counts of all four statuses, and in total."""
    return outbox.agg(*(F.count_if(F.col("delivery_status") == s).alias(s) for s in STATUSES), F.count("*").alias("total"))


def operator_dashboard(outbox: DataFrame, actions: DataFrame, events: DataFrame) -> DataFrame:
    """A2"""
    rest = [F.broadcast(df.agg(F.count("*").alias(name))) for df, name in ((actions, "operator_actions"), (events, "recent_timeline_events"))]  # one row each
    return callback_summary(outbox).crossJoin(rest[0]).crossJoin(rest[1])


def platform_health(runs: DataFrame, outbox: DataFrame, actions: DataFrame) -> DataFrame:
    """A3: stale runs and dead letters, each counted up to 200, and up to 10 recent actions."""
    def capped(df: DataFrame, name: str, cap: int) -> DataFrame:
        return F.broadcast(df.agg(F.least(F.count("*"), F.lit(cap)).alias(name)))

    return (
        callback_summary(outbox)
        .crossJoin(capped(runs.where("status = 'running'"), "stale_task_count", 200))
        .crossJoin(capped(outbox.where("delivery_status = 'dead_letter'"), "dead_letter_backlog", 200))
        .crossJoin(capped(actions, "recent_operator_actions", 10))
    )


def stale_count(runs: DataFrame) -> DataFrame:
    """A17"""
    return runs.where("status = 'running'").agg(F.count("*").alias("stale"))


def reconcile_report(**phases: DataFrame) -> DataFrame:
    """Rows of each phase."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("phase"), "n") for name, df in phases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recent_replays(actions: DataFrame, as_of: str, window: int = 300) -> DataFrame:
    """A16"""
    age = _age_seconds(F.col("created_at"), as_of)
    return actions.where((F.col("action_type") == "task_replay_requested") & age.between(0, window)).groupBy(F.col("target_id").alias("task_id")).agg(F.count("*").alias("n"))


def finalize(tasks: DataFrame, completions: DataFrame) -> DataFrame:
    """Tasks with their completions (task_id, outcome, error, callback_url) merged in: known ones updated, unknown ones added; needs_callback tells who gets an outbox row (finalize_outbox); finalize_events gives the events."""
    both = tasks.select("task_id", "status").join(completions, "task_id", "full")
    return both.select(
        "task_id",
        F.coalesce("outcome", "status").alias("status"),
        F.when(F.col("outcome") == "failed", F.left(F.col("error"), F.lit(2000))).alias("error_message"),
        (F.col("outcome").isNotNull() & (F.coalesce("callback_url", F.lit("")) != "")).alias("needs_callback"),
    )


def finalize_outbox(completions: DataFrame, as_of: str) -> DataFrame:
    """The outbox rows that completions with a URL add, pending from as_of on; the payload carries id, status and time."""
    seconds = F.unix_seconds(F.lit(as_of).cast("timestamp"))
    payload = F.to_json(F.struct(F.col("task_id"), F.col("outcome").alias("status"), seconds.alias("timestamp")))
    return completions.where("coalesce(callback_url, '') <> ''").select(
        "task_id", "callback_url", payload.alias("payload_json"), F.lit("pending").alias("delivery_status"), F.lit(0).alias("attempt_count"), F.lit(as_of).cast("timestamp").alias("next_attempt_at")
    )


def finalize_events(completions: DataFrame, as_of: str) -> DataFrame:
    """The event of each completion."""
    payload = F.to_json(F.struct(F.coalesce("callback_url", F.lit("")).alias("callback_url")))
    return completions.select("task_id", F.concat(F.lit("task_"), F.col("outcome")).alias("event_type"), payload.alias("event_payload"), F.lit(as_of).cast("timestamp").alias("created_at"))


def outbox_progress(outbox: DataFrame, outcomes: DataFrame, as_of: str, max_attempts: int = 8) -> DataFrame:
    """T3, as a batch: a delivery ends its row; a failure waits by the ladder or, after max_attempts, is dead.

    outcomes: id, delivered and, if there is such a column, tries (1 else).
    """
    rows = outbox.where("delivery_status = 'pending'").join(outcomes, "id")
    n = (F.col("attempt_count") + (F.col("tries") if "tries" in outcomes.columns else 1)).cast("int")
    dead = n >= max_attempts
    status = F.when(F.col("delivered"), "delivered").when(dead, "dead_letter").otherwise("pending")
    wait = F.when(~F.col("delivered") & ~dead, F.unix_micros(F.lit(as_of).cast("timestamp")) + scalars.callback_delay(n).cast("bigint") * 1_000_000)
    return rows.select("id", status.alias("delivery_status"), n.alias("attempt_count"), wait.alias("next_attempt_us"))
