"""Structured Streaming operators (T1-T12): continuously maintained twins of the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from opstables.operators import fsm, metrics, reconcile, schedule
from opstables.sources.tables import live
from opstables.sources.upserts import KeyedTable
from opstables.streaming.state import fold


def liveness(heartbeats: DataFrame, timeout: int = 60, delay: str = "0 seconds") -> DataFrame:
    """(node, at, state): online at a first beat, offline when none came for timeout seconds (a timer, so a node that stays silent is told, too), online at the next."""

    def step(s: list | None, at: float) -> tuple[list, list[tuple]]:
        last = max(at, s[0]) if s else at
        return [last, True], [] if s and s[1] else [(at, "online")]

    return fold(
        heartbeats, "node", "ts", [], step, None, "seen double, online boolean", "at double, state string", delay=delay,
        due=lambda s: s[0] + timeout if s and s[1] else None, expired=lambda s: ([s[0], False], [(s[0] + timeout, "offline")]),
    )


def liveness_batch(heartbeats: DataFrame, timeout: int, as_of: Column) -> DataFrame:
    """T1, as a batch: the same rows up to as_of (in microseconds), at in microseconds."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("node").orderBy("_t")
    rows = heartbeats.select("node", t.alias("_t")).withColumns({"_before": F.lag("_t").over(w), "_next": F.lead("_t").over(w)})
    silent = F.col("_t") + timeout * 1_000_000
    back = F.col("_before").isNull() | (F.col("_t") - F.col("_before") > timeout * 1_000_000)
    gone = F.coalesce(F.col("_next") > silent, silent < as_of)
    both = F.array_compact(F.array(F.when(back, F.struct(F.col("_t").alias("at"), F.lit("online").alias("state"))), F.when(gone, F.struct(silent.alias("at"), F.lit("offline").alias("state")))))
    return rows.select("node", F.inline(both))


def limiter(requests: DataFrame, window: int = 60, most: int = 100, delay: str = "0 seconds") -> DataFrame:
    """The sliding-window limiter (E13); state holds the admissions of the window, at most `most`, and goes when they have left it."""
    one = fsm.limiter_step(window, most)

    def step(s: list, at: float, id: int) -> tuple[list, list[tuple]]:
        s, rows = one(s, int(at), id)
        return s, [(int(r[0]), r[1]) for r in rows]

    return fold(requests, "entity", "ts", ["id"], step, [], "held array<long>", "id long, allowed boolean", due=lambda s: max(s) + window + 1 if s else None, delay=delay)


def machine(events: DataFrame, table: dict[tuple[str, str], str], initial: str, delay: str = "0 seconds") -> DataFrame:
    """A state machine of tasks or nodes (E15, E16); illegal events change nothing.  A state is kept for good."""
    one = fsm.machine_step(table)

    def step(s: str, at: float, id: int, event: str) -> tuple[str, list[tuple]]:
        s, rows = one(s, at, int(id), event)
        return s, [(i, prev, to, legal) for i, _, prev, to, legal in rows]

    return fold(events, "task_id", "created_at", ["id", "event"], step, initial, "state string", "id long, prev string, next string, legal boolean", due=lambda s: None, delay=delay)


def breaker(outcomes: DataFrame, threshold: int = 10, open_s: float = 60.0, delay: str = "0 seconds") -> DataFrame:
    """The capability breaker (E11); its state goes when its failures are forgotten."""
    return fold(
        outcomes, "entity", "ts", ["id", "ok"], fsm.breaker_step(threshold, open_s), fsm.BREAKER_START, "failures int, failed double, until double", fsm.BREAKER_ROWS,
        due=lambda s: max(s[1] + 4 * open_s, s[2]) if s[1] >= 0 else None, delay=delay,
    )


def client_breaker(outcomes: DataFrame, threshold: int = 5, reset_s: float = 30.0, delay: str = "0 seconds") -> DataFrame:
    """The client breaker (E12); counts don't expire, so its state is kept for good."""
    return fold(
        outcomes, "entity", "ts", ["id", "ok"], fsm.client_breaker_step(threshold, reset_s), fsm.CLIENT_BREAKER_START, "failures int, failed double, state string", fsm.CLIENT_BREAKER_ROWS,
        due=lambda s: None, delay=delay,
    )


def health(checks: DataFrame, unhealthy: int = 3, healthy: int = 2, delay: str = "0 seconds") -> DataFrame:
    """Health (E10)."""
    return fold(checks, "entity", "ts", ["id", "ok"], fsm.health_step(unhealthy, healthy), fsm.HEALTH_START, "status string, good int, bad int", "id long, status string", due=lambda s: None, delay=delay)


def alert_lifecycle(evals: DataFrame, for_s: int | None, delay: str | None = "0 seconds", key: str = "labels", time: str = "ts") -> DataFrame:
    """(key, at, state): inactive, pending while a condition holds, firing once it has for for_s seconds, resolved when it ends.

    for_s None: evals has it as a column.  Only pending and firing alerts have a state.
    """

    def step(s: list, at: float, on: bool, hold: int) -> tuple[list | None, list[tuple]]:
        state, since = s
        if not on:
            return None, [(at, "resolved")] if state == "firing" else []
        rows = []
        if state == "inactive":
            state, since = "pending", at
            rows.append((at, "pending"))
        if state == "pending" and at - since >= hold:
            state = "firing"
            rows.append((at, "firing"))
        return [state, since], rows

    held = (F.col("for_s") if for_s is None else F.lit(for_s)).cast("bigint")
    return fold(evals.withColumn("for_s", held), key, time, ["on", "for_s"], step, ["inactive", None], "state string, since double", "at double, state string", due=lambda s: None, delay=delay)


def alert_changes(sdf: DataFrame, time: str, labels: list[str], values: dict[str, Column], rules: list[tuple[str, str, int, str]], length: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """T7, E18 and T8 in one query: (alertname, severity, labels, at, state), at in seconds, as alerts change.

    values are aggregates of each window and label set; a window is evaluated once, when the watermark passes its end, by all
    rules (alertname, predicate over values, seconds that it must hold, severity; null is false), and the results go to the alert
    machine in the order of the windows' ends.  Rows later than delay are dropped before the windows.  State: windows that the
    watermark hasn't passed, and alerts that are pending or firing.  A label set without rows in a window isn't evaluated there.
    """
    win = F.window(time, length, slide) if slide else F.window(time, length)
    sums = sdf.withWatermark(time, delay).groupBy(win, *labels).agg(*(c.alias(n) for n, c in values.items()))
    timed = sums.select(F.window_time("window").alias("_at"), *labels, *values)
    tests = F.array(*(F.struct(F.lit(a).alias("alertname"), F.lit(s).alias("severity"), F.lit(d).cast("bigint").alias("for_s"), F.coalesce(F.expr(p), F.lit(False)).alias("on")) for a, p, d, s in rules))
    evals = timed.select("_at", *labels, F.inline(tests))
    own = StructType([StructField("alertname", StringType()), StructField("severity", StringType()), *(evals.schema[c] for c in labels)])
    keyed = evals.select(F.to_json(F.struct("alertname", "severity", *labels)).alias("_key"), "_at", "on", "for_s")
    changes = alert_lifecycle(keyed, None, None, "_key", "_at")
    # a window's time is a microsecond before its end
    return changes.select(F.from_json("_key", own).alias("_of"), F.round(F.col("at") + 1e-6, 5).alias("at"), "state").select("_of.*", "at", "state")


#: A stream ends when no chunk comes for IDLE seconds, or at TOTAL seconds after its first.
IDLE, TOTAL, MAX_CHUNKS = 30, 3600, 100_000


def chunks(stream: DataFrame, idle: int = IDLE, total: int = TOTAL, max_chunks: int = MAX_CHUNKS, delay: str = "0 seconds") -> DataFrame:
    """T4: (stream_id, seq, status, payload, summary): the chunks of stream (stream_id, seq, ts, raw) until each ends.

    raw is JSON; what isn't is wrapped as {"__raw__": ...}.  A chunk with __done__ ends its stream: completed, with its
    summary, or failed if it carries __error__.  Silence for idle seconds, total seconds since the first chunk (both by
    event-time timers, seq is null then) or max_chunks chunks fail it.  The end of a stream is
    remembered for total seconds after its last chunk.
    """

    def step(s: list | None, at: float, seq: int, raw: str) -> tuple[list, list[tuple]]:
        first, last, n, ended = s or [at, at, 0, False]
        if ended:
            return [first, at, n, True], []
        if n >= max_chunks:
            return [first, at, n, True], [(None, "failed", "too many chunks", None)]
        try:
            chunk = json.loads(raw)
        except (TypeError, ValueError):
            chunk = {"__raw__": raw}
        if not isinstance(chunk, dict):
            chunk = {"__raw__": raw}
        if not chunk.get("__done__"):
            return [first, at, n + 1, False], [(seq, "chunk", raw if "__raw__" not in chunk else json.dumps(chunk, ensure_ascii=False, separators=(",", ":")), None)]
        if chunk.get("__error__"):
            return [first, at, n + 1, True], [(seq, "failed", str(chunk["__error__"]), None)]
        return [first, at, n + 1, True], [(seq, "completed", None, {k: str(v) for k, v in (chunk.get("summary") or {}).items()})]

    def due(s: list | None) -> float | None:
        return None if s is None else s[1] + total if s[3] else min(s[1] + idle, s[0] + total)

    def expired(s: list) -> tuple[list | None, list[tuple]]:
        if s[3]:
            return None, []
        return [s[0], s[1], s[2], True], [(None, "failed", "timeout" if s[0] + total <= s[1] + idle else "idle", None)]

    return fold(stream, "stream_id", "ts", ["seq", "raw"], step, None, "first double, seen double, n long, ended boolean", "seq long, status string, payload string, summary map<string,string>", due=due, expired=expired, delay=delay)


def chunks_batch(stream: DataFrame, as_of: Column, idle: int = IDLE, total: int = TOTAL, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """T4, as a batch over all chunks up to as_of (in seconds): each stream's rows until its first end."""
    w = Window.partitionBy("stream_id").orderBy("ts", "seq")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    parsed = F.try_parse_json("raw")
    kind = F.try_variant_get(parsed, "$", "map<string,variant>")
    done = F.coalesce(F.try_variant_get(parsed, "$.__done__", "boolean"), F.lit(False))
    rows = stream.select("stream_id", "seq", "ts", "raw", t.alias("_t"), kind.isNotNull().alias("_json"), done.alias("_done"), F.try_variant_get(parsed, "$.__error__", "string").alias("_error"), F.try_variant_get(parsed, "$.summary", "map<string,string>").alias("_summary"))
    first = F.min("_t").over(Window.partitionBy("stream_id"))
    limit = F.least(F.coalesce(F.lag("_t").over(w), F.col("_t")) + idle, F.col("_first") + total)
    rows = rows.withColumn("_first", first).withColumns({"_n": F.row_number().over(w), "_late": F.col("_t") > limit, "_limit": limit, "_last": F.lead("_t").over(w).isNull()})
    ends = F.col("_done") | F.col("_late") | (F.col("_n") > max_chunks)
    rows = rows.withColumn("_end", ends).withColumn("_ended", F.coalesce(F.max(F.col("_end").cast("int")).over(earlier), F.lit(0))).where("_ended = 0")
    reason = F.when(F.col("_first") + total <= F.col("_before") + idle, "timeout").otherwise("idle")
    before = F.coalesce(F.lag("_t").over(w), F.col("_t"))
    rows = rows.withColumn("_before", before)

    def item(seq: Column, status: str, payload: Column, summary: Column | None = None) -> Column:
        return F.struct(seq.alias("seq"), F.lit(status).alias("status"), payload.alias("payload"), (F.lit(None).cast("map<string,string>") if summary is None else summary).alias("summary"))

    none = F.lit(None).cast("bigint")
    wrapped = F.when(F.col("_json"), F.col("raw")).otherwise(F.to_json(F.struct(F.col("raw").alias("__raw__"))))
    own = (
        F.when(F.col("_late"), item(none, "failed", reason)).when(F.col("_n") > max_chunks, item(none, "failed", F.lit("too many chunks")))
        .when(F.col("_done") & (F.coalesce("_error", F.lit("")) != ""), item(F.col("seq"), "failed", F.col("_error")))
        .when(F.col("_done"), item(F.col("seq"), "completed", F.lit(None).cast("string"), F.coalesce("_summary", F.create_map().cast("map<string,string>")))).otherwise(item(F.col("seq"), "chunk", wrapped))
    )
    silent = F.least(F.col("_t") + idle, F.col("_first") + total)
    after = F.when(F.col("_last") & ~F.col("_end") & (silent < as_of), item(none, "failed", F.when(F.col("_first") + total <= F.col("_t") + idle, "timeout").otherwise("idle")))
    return rows.select("stream_id", F.inline(F.array_compact(F.array(own, after))))


def deduplicated(sdf: DataFrame, time: str, keys: list[str], delay: str = "300 seconds") -> DataFrame:
    """T5: the first row of each key within the watermark's delay."""
    return sdf.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(sdf: DataFrame, time: str, labels: list[str], length: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per window and labels; later rows than the watermark are dropped."""
    win = F.window(time, length, slide) if slide else F.window(time, length)  # a row is in length / slide windows
    return sdf.withWatermark(time, delay).groupBy(win, *labels).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *labels, "n")


def windowed_rates(sdf: DataFrame, time: str, labels: list[str], length: str = "5 minutes", slide: str | None = "15 seconds", delay: str = "10 minutes") -> DataFrame:
    """Events a second, per (sliding) window and labels."""
    counts = windowed_counts(sdf, time, labels, length, slide, delay)
    seconds = F.lit(float(pd.Timedelta(length).total_seconds()))
    return counts.select("window_start", *labels, (F.col("n") / seconds).alias("rate"))


def windowed_histogram(sdf: DataFrame, time: str, value: str, labels: list[str], bounds: tuple[float, ...] = metrics.BOUNDS, length: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Cumulative buckets (+Inf last) per (sliding) window and labels, as A9."""
    win = F.window(time, length, slide) if slide else F.window(time, length)
    rows = sdf.withWatermark(time, delay).withColumn("window", win)
    found = metrics.histogram(rows, value, ["window", *labels], bounds)
    return found.select(F.col("window.start").alias("window_start"), *labels, "le", "cumulative", "count")


def totals(sdf: DataFrame, labels: list[str]) -> DataFrame:
    """Counts kept up to date (output mode complete or update)."""
    return sdf.groupBy(*labels).agg(F.count("*").alias("n"))


def latest_status(sdf: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each key's last value."""
    return sdf.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_table(sdf: DataFrame, table: KeyedTable, columns: list[str]) -> DataStreamWriter:
    """Each key's last row by the table's order, merged batch by batch; the stream keeps no state, and a batch that is run again changes nothing."""
    return sdf.select(*columns).writeStream.foreachBatch(lambda batch, n: table.merge(batch, n))


#: For how long a task that was acted on is passed over, in seconds.
ACTED_S = 300


def stuck_actions(cache: DataFrame, leases: DataFrame, as_of: Callable[[], str], actions: KeyedTable, seen: Callable[[], DataFrame] | None = None, cap: int | None = None) -> DataStreamWriter:
    """On every batch of cache rows the stuck tasks' dispositions are added to actions (by task_id), with the time acted_at.

    Tasks that stand there for less than ACTED_S seconds, and those that seen gives, are passed over.
    """

    def act(batch: DataFrame, n: int) -> None:
        now = as_of()
        columns = reconcile.stuck_disposition(batch.limit(0)).withColumn("acted_at", F.lit(now).cast("timestamp"))
        recent = live(actions.read(columns.schema), "acted_at", ACTED_S, now).select("task_id")
        recent = recent if seen is None else recent.unionByName(seen().select("task_id"))
        once = batch.dropDuplicates(["task_id"])
        found = reconcile.stuck_disposition(reconcile.stuck_tasks(once, leases, recent, now, cap=cap))
        actions.merge(found.withColumn("acted_at", F.lit(now).cast("timestamp")), n)

    return cache.writeStream.foreachBatch(act)


#: How long dead letters are kept, in seconds.
DEAD_LETTER_TTL = 30 * 86400


def retained_dead_letters(dead: DataFrame, as_of: str, ttl: int = DEAD_LETTER_TTL, time: str = "died_at") -> DataFrame:
    """Dead letters younger than 30 days."""
    return live(dead, time, ttl, as_of)


def outbox_updates(outcomes: DataFrame, outbox: KeyedTable, as_of: str, dead: KeyedTable) -> DataStreamWriter:
    """Delivery outcomes advance the outbox (by id) from what earlier batches left; several of a batch count each.

    Dead letters go to a table of their own, too, with the time (died_at) from which they are retained; they are written first, so a
    batch that broke off between the two is whole when it is run again.
    """

    def act(batch: DataFrame, n: int) -> None:
        if outbox.has(n):
            return
        told = batch.groupBy("id").agg(F.max("delivered").alias("delivered"), F.count("*").alias("tries"))
        rows = reconcile.outbox_progress(outbox.read(), told, as_of).persist()
        dead.merge(rows.where("delivery_status = 'dead_letter'").withColumn("died_at", F.lit(as_of).cast("timestamp")), n)
        outbox.update(rows, n)
        rows.unpersist()

    return outcomes.writeStream.foreachBatch(act)


def cron_ticks(ticks: DataFrame, schedules: KeyedTable, fired: KeyedTable) -> DataStreamWriter:
    """On every batch of ticks (timestamp) the schedules due by the last one give their tasks; ticks missed between are one fire.

    fired (by idempotency_key) is written first, then the next_fire_at of the fired ones in schedules (by
    schedule_id), so that the next batch doesn't fire them again.  A batch that is run again gives the same keys.
    """

    def act(batch: DataFrame, n: int) -> None:
        last = batch.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss")).first()[0]
        if last and not schedules.has(n):
            due = schedule.due_schedules(schedules.read(), last)
            fired.merge(schedule.fire(due, last), n)
            at = schedule.next_fire(due.drop("next_fire_at"), "cron_expr", last)
            schedules.update(at.select("schedule_id", F.date_format("next_fire_at", "yyyy-MM-dd'T'HH:mm:ss").alias("next_fire_at")), n)

    return ticks.writeStream.foreachBatch(act)
