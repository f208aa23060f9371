"""Priority queues: positions, admission, picks, set moves and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opstables.operators.audit import top_per_key
from opstables.operators.ordered import as_of
from opstables.operators.ranks import split_rank
from opstables.sources.scratch import stored

#: A score is rank * RANK_UNIT + milliseconds.
RANK_UNIT = 10**13
MAX_DEPTH, MAX_CONCURRENT, SCAN_LIMIT = 1000, 8, 50


def limits(entries: DataFrame, config: DataFrame) -> DataFrame:
    """capability, pending, running, max_queue_depth, max_concurrent: unset limits, and those of 0 or less, are the defaults (A4)."""
    def limit(c: str, default: int) -> Column:
        return F.when(F.col(c) > 0, F.col(c)).otherwise(default).cast("bigint").alias(c)

    counts = entries.groupBy("capability").agg(F.count_if(F.col("queue_set") == "pending").alias("pending"), F.count_if(F.col("queue_set") == "running").alias("running"))
    return counts.join(config, "capability", "left").select("capability", "pending", "running", limit("max_queue_depth", MAX_DEPTH), limit("max_concurrent", MAX_CONCURRENT))


def positions(entries: DataFrame) -> DataFrame:
    """Places of the pending entries, from 1, by score and member; a hot capability is ranked by many tasks."""
    pending = entries.where("queue_set = 'pending'").select("capability", "task_id", "score")
    return split_rank(pending, ["capability"], "score", ["task_id"], "position").select("capability", "task_id", "position")


def _ready(entries: DataFrame, as_of_ms: int, scan_limit: int | None) -> DataFrame:
    """Ready entries among the first scan_limit of each capability."""
    pending = entries.where("queue_set = 'pending'").select("capability", "task_id", "score")
    seen = pending if scan_limit is None else top_per_key(pending, ["capability"], [F.col("score"), F.col("task_id")], scan_limit, "_seen").drop("_seen")
    return seen.where(F.col("score") % RANK_UNIT <= as_of_ms)


def fill_slots(entries: DataFrame, config: DataFrame, as_of_ms: int, scan_limit: int | None = SCAN_LIMIT) -> DataFrame:
    """The tasks that fill each capability's free slots, in order."""
    ready = _ready(entries, as_of_ms, scan_limit)
    if scan_limit is None:  # a whole queue may be ready
        ranked = split_rank(ready, ["capability"], "score", ["task_id"], "rank")
    else:
        ranked = ready.withColumn("rank", F.row_number().over(Window.partitionBy("capability").orderBy("score", "task_id")))
    free = limits(entries, config).select("capability", (F.col("max_concurrent") - F.col("running")).alias("free"))
    return ranked.join(free, "capability").where("rank <= free").select("capability", "task_id", "rank")


def next_ready(entries: DataFrame, config: DataFrame, as_of_ms: int, scan_limit: int | None = SCAN_LIMIT) -> DataFrame:
    """The next task of each capability that has a free slot."""
    return fill_slots(entries, config, as_of_ms, scan_limit).where("rank = 1").drop("rank")


def admit(arrivals: DataFrame, entries: DataFrame, config: DataFrame) -> DataFrame:
    """Arrivals (capability, task_id, seq) are accepted while their queue is below its depth."""
    state = limits(entries, config).select("capability", "pending", "max_queue_depth")
    rows = split_rank(arrivals, ["capability"], "seq", ["task_id"], "_n").join(state, "capability", "left")
    depth, before = F.coalesce("max_queue_depth", F.lit(MAX_DEPTH)), F.coalesce("pending", F.lit(0))
    accepted = before + F.col("_n") <= depth
    return rows.select(
        "capability", "task_id", accepted.alias("accepted"), F.when(accepted, before + F.col("_n")).alias("position"), F.least(before + F.col("_n"), F.greatest(depth, before)).alias("pending_count")
    )


def admit_slots(arrivals: DataFrame, entries: DataFrame, config: DataFrame) -> DataFrame:
    """E5: as E4, on running slots."""
    state = limits(entries, config).select("capability", "running", "max_concurrent")
    rows = split_rank(arrivals, ["capability"], "seq", ["task_id"], "_n").join(state, "capability", "left")
    fits = F.coalesce("running", F.lit(0)) + F.col("_n") <= F.coalesce("max_concurrent", F.lit(MAX_CONCURRENT))
    return rows.select("capability", F.col("task_id").alias("slot_id"), fits.alias("acquired"))


def node_order(nodes: DataFrame) -> DataFrame:
    """Idle nodes with GPUs in the order in which they are taken, largest first: place (from 1), node_id, gpus and running_gpus, the total before the node.

    The total of all larger sizes (one row a size) and the place among nodes of the same size make the totals; no task sees all nodes.
    """
    idle = nodes.where("state = 'idle' AND gpus > 0").select("node_id", "gpus")
    sizes = idle.groupBy("gpus").agg(F.sum("gpus").alias("_sum"), F.count("*").alias("_count"))
    w = Window.orderBy(F.col("gpus").desc()).rowsBetween(Window.unboundedPreceding, -1)
    larger = sizes.select("gpus", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("_sum", "_count")))
    placed = split_rank(idle, ["gpus"], "node_id", [], "_place").join(larger, "gpus")
    return placed.select((F.col("_count_before") + F.col("_place")).alias("place"), "node_id", "gpus", (F.col("_sum_before") + (F.col("_place") - 1) * F.col("gpus")).alias("running_gpus"))


def _cuts(requests: DataFrame, order: DataFrame) -> DataFrame:
    # totals are whole and rise from node to node, so the last node with a total below the need is the last one up to ceil(need) - 1
    asked = requests.select("request_id", "required_gpus", (F.ceil("required_gpus").cast("bigint") - 1).alias("_below"))
    at = as_of(asked, order, [], "_below", "running_gpus", {"place": "_place", "gpus": "_gpus"}, "_before")
    taken = F.coalesce(F.col("_before") + F.col("_gpus"), F.lit(0))
    return at.select("request_id", "required_gpus", F.coalesce("_place", F.lit(0)).alias("n_nodes"), taken.alias("taken_gpus"), F.coalesce(taken >= F.col("required_gpus"), F.lit(False)).alias("met"))


def node_cuts(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """E6, a row a request: the first n_nodes of node_order are its nodes, taken_gpus their total, met whether that is enough.

    Requests are placed among the running totals by an as-of join in pieces; nothing is paired.  A null need takes no
    node and isn't met; one of 0 or less takes none and is.
    """
    return _cuts(requests, node_order(nodes))


def greedy_nodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """E6 as pairs: for each request, idle nodes by GPUs, largest first, while the total before a node is below the need.

    The pairs are the places up to each request's cut, joined with the node order by place.
    """
    order = stored(node_order(nodes), "node-order")
    places = _cuts(requests, order).where("n_nodes > 0").select("request_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_nodes"))).alias("place"))
    return places.join(order, "place").select("request_id", "node_id", "gpus", "running_gpus")


def least_loaded(workers: DataFrame, next_idx: int) -> DataFrame:
    """Per pool the worker with the fewest pending calls, ties round-robin from next_idx."""
    sizes = workers.groupBy("pool").agg(F.count("*").alias("_size"))
    turn = F.pmod(F.col("idx") - F.lit(next_idx), F.col("_size"))
    return top_per_key(workers.join(sizes, "pool"), ["pool"], [F.col("pending"), turn, F.col("idx")], 1, "_r").drop("_r", "_size")


def tripped(faults: DataFrame, window: int = 300, n: int = 3) -> DataFrame:
    """After each fault, whether the worker has n of them in the last window seconds (the window's far end excluded)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("worker").orderBy("at_us").rangeBetween(-(window * 10**6 - 1), 0)
    return faults.withColumn("at_us", at).select("worker", "id", "at_us", (F.count("*").over(w) >= n).alias("tripped"))


def queue_stats(entries: DataFrame, events: DataFrame) -> DataFrame:
    """A5: current sizes and lifetime totals."""
    sizes = entries.groupBy("capability").agg(F.count_if(F.col("queue_set") == "pending").alias("pending"), F.count_if(F.col("queue_set") == "running").alias("running"))
    kinds = {"enqueue": "total_enqueued", "start": "total_dequeued", "complete": "total_completed", "fail": "total_failed"}
    totals = events.groupBy("capability").agg(*(F.count_if(F.col("event") == k).alias(v) for k, v in kinds.items()))
    return sizes.join(totals, "capability", "full").na.fill(0)


def capabilities(entries: DataFrame, cap: int = 2000) -> DataFrame:
    """A14"""
    return entries.select("capability").distinct().orderBy("capability").limit(cap)


def visible_caps(all_caps: DataFrame, tenant_caps: DataFrame) -> DataFrame:
    """U1"""
    return all_caps.select("capability").intersect(tenant_caps.select("capability"))


def start_tasks(entries: DataFrame, picked: DataFrame, as_of_ms: int) -> DataFrame:
    """Picked entries go from pending to running, scored by the time."""
    chosen = picked.select("capability", "task_id", F.lit(True).alias("_picked"))
    rows = entries.join(chosen, ["capability", "task_id"], "left")
    moved = F.col("_picked") & (F.col("queue_set") == "pending")
    return rows.select("capability", "task_id", F.when(moved, "running").otherwise(F.col("queue_set")).alias("queue_set"), F.when(moved, F.lit(as_of_ms)).otherwise(F.col("score")).alias("score"))


def cancel_entries(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """U4: where each request finds its task: pending, else running, else nowhere."""
    found = requests.join(entries.select("capability", "task_id", "queue_set"), ["capability", "task_id"], "left")
    return found.groupBy("capability", "task_id").agg(F.coalesce(F.min("queue_set"), F.lit("absent")).alias("removed_from"))


def cancel_verdict(tasks: DataFrame) -> DataFrame:
    """Only queued tasks can be cancelled."""
    ended = F.col("status").isin("completed", "failed", "cancelled")
    reason = F.when(ended, "already ended").when(F.col("status") != "queued", "illegal transition").otherwise("ok")
    return tasks.select("task_id", "status", (F.col("status") == "queued").alias("cancelled"), reason.alias("reason"))


def finish_entries(entries: DataFrame, finished: DataFrame) -> DataFrame:
    """Running entries that remain, and counter bumps, per capability; a release bumps no counter."""
    running = entries.where("queue_set = 'running'")
    left = running.join(finished, ["capability", "task_id"], "left_anti").groupBy("capability").agg(F.count("*").alias("still_running"))
    bumps = finished.groupBy("capability").agg(F.count_if(F.col("outcome") == "complete").alias("completed"), F.count_if(F.col("outcome") == "fail").alias("failed"))
    return left.join(bumps, "capability", "full").na.fill(0)


def drop_tenants(keys: DataFrame, removed: DataFrame) -> DataFrame:
    """A tenant's keys go with it."""
    return keys.join(removed, "tenant_id", "left_anti")
