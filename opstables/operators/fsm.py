"""State over ordered events per key: streaks, health, breakers, limiters, state machines, durations.

Closed forms over windows where they exist.  Machines and clamped counters are compositions of functions of the state, one
an event, composed in pieces of a key (ordered.py).  The others forget: after a quiet time nothing of what was before
matters, so a key's events are cut there, and each segment is folded by itself, in order, holding its state only.
The steps of the folds are plain functions of (state, event), which streams use as well.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opstables.operators.ordered import Pieces, as_of, pieces
from opstables.operators.runs import Step, fold_sorted

#: Legal transitions of tasks and of nodes.
TASK_TABLE = {
    ("pending", "schedule"): "scheduled",
    ("pending", "enqueue"): "queued",
    ("scheduled", "enqueue"): "queued",
    ("queued", "start"): "running",
    ("running", "complete"): "completed",
    ("running", "fail"): "failed",
    ("running", "stale_fail"): "failed",
    ("running", "requeue"): "queued",
    ("queued", "cancel"): "cancelled",
}
NODE_TABLE = {
    ("idle", "reserve"): "reserved",
    ("reserved", "join"): "joined",
    ("joined", "drain"): "draining",
    ("draining", "release"): "idle",
    ("joined", "release"): "idle",
    ("idle", "offline"): "offline",
    ("reserved", "offline"): "offline",
    ("joined", "offline"): "offline",
    ("draining", "offline"): "offline",
    ("offline", "release"): "idle",
}


def streaks(df: DataFrame, key: str, ok: str, order: list[str]) -> DataFrame:
    """Successes and failures in a row, up to each event."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_run", F.when(F.lag(ok).over(w) == F.col(ok), 0).otherwise(1)).withColumn("_island", F.sum("_run").over(w))
    n = F.row_number().over(Window.partitionBy(key, "_island").orderBy(*order))
    rows = rows.withColumn("_n", n)
    zero = F.lit(0)
    return rows.withColumns({"consec_ok": F.when(F.col(ok), F.col("_n")).otherwise(zero), "consec_fail": F.when(F.col(ok), zero).otherwise(F.col("_n"))}).drop("_run", "_island", "_n")


def health_state(checks: DataFrame, key: str, ok: str, order: list[str], unhealthy: int = 3, healthy: int = 2) -> DataFrame:
    """Degraded at 2 failures in a row, unhealthy at the threshold, healthy again at healthy successes in a row (closed form, for thresholds of 3 or more)."""
    if unhealthy < 3:
        raise ValueError("the closed form holds for unhealthy thresholds of 3 or more")
    w = Window.partitionBy(key).orderBy(*order)
    rows = streaks(checks, key, ok, order).withColumn("_episode", F.sum((F.col("consec_ok") == healthy).cast("int")).over(w))
    worst = F.max("consec_fail").over(Window.partitionBy(key, "_episode").orderBy(*order))
    status = F.when(worst >= unhealthy, "unhealthy").when(worst >= 2, "degraded").otherwise("healthy")
    return rows.withColumn("status", status).drop("_episode")


def _seconds(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def health_step(unhealthy: int = 3, healthy: int = 2) -> Step:
    """The status after each check; state: status, successes and failures in a row."""

    def step(s: list, t: float, id: int, ok: bool) -> tuple[list, list[tuple]]:
        status, good, bad = s
        good, bad = (good + 1, 0) if ok else (0, bad + 1)
        if status != "healthy" and good >= healthy:
            status = "healthy"
        elif status == "healthy" and bad >= 2:
            status = "degraded"
        elif status == "degraded" and bad >= unhealthy:
            status = "unhealthy"
        return [status, good, bad], [(id, status)]

    return step


HEALTH_START = ["healthy", 0, 0]


def breaker_step(threshold: int = 10, open_s: float = 60.0) -> Step:
    """E11; state: failures, time of the last one, end of the open time."""

    def step(s: list, t: float, id: int, ok: bool) -> tuple[list, list[tuple]]:
        n, last, until = s
        is_open = t < until
        if t - last >= 4 * open_s:
            n = 0
        n = 0 if ok else n if is_open else n + 1
        trips = not is_open and not ok and n >= threshold
        if trips:
            n, until = 0, t + open_s
        return [n, last if ok or is_open else t, until], [(id, "open" if trips or is_open else "closed", n)]

    return step


BREAKER_START = [0, -1.0, -1.0]


def client_breaker_step(threshold: int = 5, reset_s: float = 30.0) -> Step:
    """E12; state: failures, time of the last one, closed, open or half_open."""

    def step(s: list, t: float, id: int, ok: bool) -> tuple[list, list[tuple]]:
        n, last, state = s
        half = state == "half_open" or (state == "open" and t - last > reset_s)
        if state != "closed" and not half:
            return [n, last, "open"], [(id, False, "open")]
        n, last = (0, last) if ok else (n + 1, t)
        state = "closed" if ok else "open" if n >= threshold else "half_open" if half else "closed"
        return [n, last, state], [(id, True, state)]

    return step


CLIENT_BREAKER_START = [0, -1.0, "closed"]


def limiter_step(window: int = 60, most: int = 100, collapse_same_second: bool = True) -> Step:
    """E13; state: the seconds of the window's admissions, at most `most`."""

    def step(s: list, t: int, id: int) -> tuple[list, list[tuple]]:
        held = [x for x in s if x > t - window]
        if len(held) >= most:
            retry = max(1, min(held) + window - t)
            return held, [(id, False, 0, retry, t + retry)]
        left = most - len(held) - 1
        if not (collapse_same_second and t in held):
            held.append(t)
        return held, [(id, True, left, 0, t + window)]

    return step


def machine_step(table: dict[tuple[str, str], str]) -> Step:
    """E15, E16; state: the state."""

    def step(s: str, t: float, id: int, event: str) -> tuple[str, list[tuple]]:
        to = table.get((s, event))
        return to or s, [(id, event, s, to or s, to is not None)]

    return step


BREAKER_ROWS, CLIENT_BREAKER_ROWS = "id bigint, state string, failures int", "id bigint, allowed boolean, state string"
LIMITER_ROWS = "id bigint, allowed boolean, remaining bigint, retry_after bigint, reset bigint"
MACHINE_ROWS = "id bigint, event string, prev string, next string, legal boolean"


def _fold_segments(held: Pieces, order: list[str], fresh: Column, fields: list[str], start: Any, step: Step, schema: str) -> DataFrame:
    """The fold of rows that begins anew where fresh holds: there, the state before is as good as the first one."""
    cut = held.running_sum(order, {"_segment": F.coalesce(fresh, F.lit(False)).cast("long")})
    return fold_sorted(cut.plain(), [*held.keys, "_segment"], order, fields, start, step, schema).drop("_segment")


def breaker_timeline(outcomes: DataFrame, key: str, threshold: int = 10, open_s: float = 60.0) -> DataFrame:
    """Outcomes (key, ts, id, ok): state after each.  Open after threshold failures since the last success;
    while open, failures count for nothing; after open_s it is closed with no failures.  Failures are forgotten 4 * open_s after the last.
    A null outcome counts as a failure.
    """
    rows = outcomes.select(key, _seconds().alias("t"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    order = ["t", "id"]
    seen = pieces(rows, [key], "t").last_before(order, {"_prev": F.struct("t", "ok"), "_failed": F.when(~F.col("ok"), F.col("t"))})
    # all is forgotten, or a success came last and nothing of the last open_s can have opened it
    quiet = (F.col("t") - F.col("_prev.t") >= 4 * open_s) | (F.col("_prev.ok") & (F.col("_failed").isNull() | (F.col("t") - F.col("_failed") >= open_s)))
    return _fold_segments(seen, order, quiet, ["ok"], BREAKER_START, breaker_step(threshold, open_s), BREAKER_ROWS)


def client_breaker_timeline(outcomes: DataFrame, key: str, threshold: int = 5, reset_s: float = 30.0) -> DataFrame:
    """Whether each call is allowed, and the state after it.  Open at threshold failures without a success between; a call more than
    reset_s after the last failure makes it half-open, where a success closes and a failure opens it.
    """
    rows = outcomes.select(key, _seconds().alias("t"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    order = ["t", "id"]
    held = pieces(rows, [key], "t").last_before(order, {"_failed": F.when(~F.col("ok"), F.col("t"))})
    # a success that was surely allowed closes it, whatever was before
    closes = F.col("ok") & (F.col("_failed").isNull() | (F.col("t") - F.col("_failed") > reset_s))
    held = held.last_before(order, {"_closed": F.struct(closes.alias("by"))})
    return _fold_segments(held, order, F.col("_closed.by"), ["ok"], CLIENT_BREAKER_START, client_breaker_step(threshold, reset_s), CLIENT_BREAKER_ROWS)


def rate_limit(requests: DataFrame, key: str, window: int = 60, most: int = 100, collapse_same_second: bool = True) -> DataFrame:
    """Admitted if fewer than most admissions lie in the last window seconds; only admissions count (by default those of one second as one)."""
    rows = requests.select(key, F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "id")
    order = ["t", "id"]
    held = pieces(rows, [key], "t").last_before(order, {"_prev": F.col("t")})
    return _fold_segments(held, order, F.col("t") - F.col("_prev") >= window, [], [], limiter_step(window, most, collapse_same_second), LIMITER_ROWS)


def concurrency_timeline(outcomes: DataFrame, key: str, baseline: int = 8, down: int = 1) -> DataFrame:
    """A failure lowers the limit (to 1 at least), a success raises it by 1 up to the baseline.

    An outcome is a shift with bounds, and so are outcomes in a row.
    """
    rows = outcomes.select(key, _seconds().alias("t"), "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    far = 2**40

    def shift(by: Column, low: Column, high: Column) -> Column:
        return F.struct(by.cast("long").alias("by"), low.cast("long").alias("low"), high.cast("long").alias("high"))

    def bounded(x: Column, f: Column) -> Column:
        return F.greatest(f["low"], F.least(f["high"], x + f["by"]))

    own = F.when(F.col("ok"), shift(F.lit(1), F.lit(-far), F.lit(baseline))).otherwise(shift(F.lit(-down), F.lit(1), F.lit(far)))
    both = lambda f, g: shift(f["by"] + g["by"], bounded(f["low"], g), bounded(f["high"], g))
    before = pieces(rows, [key], "t").composed_before(["t", "id"], own, both, shift(F.lit(0), F.lit(-far), F.lit(far)), "_before").plain()
    limit = bounded(bounded(F.lit(baseline), F.col("_before")), own)
    return before.select(key, "id", limit.cast("int").alias("max_concurrent"))


def _next_state(table: dict[tuple[str, str], str], state: Column, event: Column) -> Column:
    m = F.create_map(*(F.lit(x) for (a, b), c in table.items() for x in (f"{a}|{b}", c)))
    return F.try_element_at(m, F.concat(state, F.lit("|"), event))


def replay_fsm(events: DataFrame, key: str, table: dict[tuple[str, str], str] = TASK_TABLE, initial: str = "pending", time: str = "created_at") -> DataFrame:
    """Each event's state before and after; an illegal event changes nothing and is flagged.

    An event is a map from states to states, as an array of their numbers; such maps are composed.
    """
    rows = events.select(key, _seconds(time).alias("t"), "id", "event")
    states = sorted({initial, *(a for a, _ in table), *table.values()})
    numbers = lambda to: F.array(*(F.lit(states.index(to(s))).cast("tinyint") for s in states))
    unchanged = numbers(lambda s: s)
    maps = F.create_map(*(x for e in sorted({e for _, e in table}) for x in (F.lit(e), numbers(lambda s, e=e: table.get((s, e), s)))))
    own = F.coalesce(F.try_element_at(maps, F.col("event")), unchanged)
    both = lambda f, g: F.transform(f, lambda x: F.get(g, x))
    before = pieces(rows, [key], "t").composed_before(["t", "id"], own, both, unchanged, "_before").plain()
    prev = F.get(F.array(*map(F.lit, states)), F.get(F.col("_before"), F.lit(states.index(initial))))
    to = _next_state(table, F.col("prev"), F.col("event"))
    shown = before.select(key, "id", "event", prev.alias("prev")).withColumn("_to", to)
    return shown.select(key, "id", "event", "prev", F.coalesce("_to", "prev").alias("next"), F.col("_to").isNotNull().alias("legal"))


def transition(df: DataFrame, state: str, event: str, table: dict[tuple[str, str], str] = TASK_TABLE) -> DataFrame:
    """E15, one step: the next state, null if the event is illegal."""
    return df.withColumn("next_state", _next_state(table, F.col(state), F.col(event)))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's last row; partial maxima travel, not histories."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def durations(events: DataFrame, key: str, start: str, ends: tuple[str, ...]) -> DataFrame:
    """Seconds from each key's first start to its first end after it, and which end that is."""
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    first = F.min(F.when(F.col("event") == start, t)).over(Window.partitionBy(key))
    later = events.withColumns({"_t": t, "_first": first}).where(F.col("event").isin(*ends) & (F.col("_t") > F.col("_first")))
    return later.groupBy(key, "_first").agg(F.min("_t").alias("_end"), F.min_by("event", F.struct("_t", "id")).alias("outcome")).select(key, ((F.col("_end") - F.col("_first")) / 1e6).alias("seconds"), "outcome")


def scale_advice(snapshots: DataFrame, key: str, up: float = 0.8, down: float = 0.2, cooldown: int = 300) -> DataFrame:
    """Snapshots (key, t in seconds, utilization): scale up or down unless the last advice is younger than the cooldown."""

    def step(last: int, t: int, use: float) -> tuple[Any, list[tuple]]:
        wants = 1 if use >= up else -1 if use <= down else 0
        if not wants or t - last < cooldown:
            return last, [(t, "hold", 0)]
        return t, [(t, "up" if wants > 0 else "down", wants)]

    rows = snapshots.where("utilization IS NOT NULL").select(key, "t", "utilization")
    wants = (F.col("utilization") >= up) | (F.col("utilization") <= down)
    held = pieces(rows, [key], "t").last_before(["t"], {"_wanted": F.when(wants, F.col("t"))})
    # no advice can be as young as that where none was wanted for so long
    return _fold_segments(held, ["t"], wants & (F.col("t") - F.col("_wanted") >= cooldown), ["utilization"], -1_000_000_000, step, "t bigint, advice string, delta int")


def coalesce_ticks(ticks: DataFrame, polls: DataFrame, every: int) -> DataFrame:
    """One fire of each schedule at each poll (polls every `every` seconds): its last tick since the poll before."""
    w = Window.partitionBy("schedule_id", "poll_at")
    rows = ticks.withColumn("poll_at", F.expr(f"(t + {every - 1}) DIV {every} * {every}")).withColumns({"fire_at": F.max("t").over(w), "missed": F.count("*").over(w) - 1})
    return rows.join(polls, "poll_at", "left_semi").select("schedule_id", "poll_at", "fire_at", "missed").distinct()


def coalesce_to_polls(ticks: DataFrame, polls: DataFrame, every: int) -> DataFrame:
    """E23 with polls left out: each tick counts at the first poll at or after it; ticks after the last poll aren't due yet.

    `every` tells nothing here: polls may come at any times.  Ticks and polls are matched in one order, in pieces of time.
    """
    at = polls.select("poll_at").where("poll_at IS NOT NULL").distinct()
    due = as_of(ticks, at, [], "t", "poll_at", {}, "poll_at", after=True).where("poll_at IS NOT NULL")
    return due.groupBy("schedule_id", "poll_at").agg(F.max("t").alias("fire_at"), (F.count("*") - 1).alias("missed"))
