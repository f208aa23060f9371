"""Streams run over files until these are read, compared with their batch twins."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opstables.operators import fsm, ranks
from opstables.plans import fixtures, streams
from opstables.sources import tables
from opstables.sources.upserts import KeyedTable
from opstables.streaming import operators as T

SMALL = "/root/testdata/sf0.001"


def drained(writer, path):
    q = writer.option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_state_machine_stream_equals_batch(spark):
    events = fixtures.view(spark, SMALL, "task_events")
    stream = streams._events(streams._stream(spark, SMALL, "events")).drop("value")
    got = streams.run(spark, T.machine(stream, fsm.TASK_TABLE, "pending"))
    want = fsm.replay_fsm(events, "task_id").select("task_id", "id", "prev", "next", "legal")
    assert sorted(got.collect()) == sorted(want.collect())


def test_limiter_stream_equals_batch(spark):
    checks = fixtures.view(spark, SMALL, "health_checks")
    got = streams.QUERIES["t6_limiter"](spark, SMALL).select("entity", "id", "allowed").collect()
    want = fsm.rate_limit(checks, "entity", window=86400, most=2).select("entity", "id", "allowed").collect()
    assert sorted(got) == sorted(want)


def test_outbox_goes_on_across_batches(spark, tmp_path):
    """Three batches; one callback fails twice, in one of them; the others fail on, or end.  A batch that is run again changes nothing."""
    outbox, dead = KeyedTable(spark, f"{tmp_path}/outbox", ["id"]), KeyedTable(spark, f"{tmp_path}/dead", ["id"])
    schema = "id bigint, delivery_status string, attempt_count int, next_attempt_us bigint, url string"
    outbox.merge(spark.createDataFrame([(1, "pending", 0, None, "a"), (2, "pending", 6, None, "b"), (3, "pending", 1, None, "c"), (4, "delivered", 1, None, "d"), (5, "pending", 0, None, "e")], schema))
    parts = [[(1, False), (2, False), (3, False), (4, False)], [(2, False), (1, False), (9, True)], [(1, True), (2, False), (5, False), (5, False)]]
    outcomes = batches(spark, tmp_path, "in", "id bigint, delivered boolean", *parts)
    drained(T.outbox_updates(outcomes, outbox, "2024-01-01 00:00:00", dead), tmp_path / "c")

    def state():
        return {r.id: (r.delivery_status, r.attempt_count, r.url) for r in outbox.read().collect()}

    want = {1: ("delivered", 3, "a"), 2: ("dead_letter", 8, "b"), 3: ("pending", 2, "c"), 4: ("delivered", 1, "d"), 5: ("pending", 2, "e")}
    assert state() == want and [r.id for r in dead.read().collect()] == [2]
    again = spark.createDataFrame([(3, "delivered", 99)], "id bigint, delivery_status string, attempt_count int")
    assert not outbox.update(again, 2) and not outbox.merge(again, 0) and state() == want
    drained(T.outbox_updates(outcomes, outbox, "2024-01-01 00:00:00", dead), tmp_path / "lost checkpoint")
    assert state() == want


def test_keyed_tables(spark, tmp_path, monkeypatch):
    import random

    from opstables.sources import upserts

    monkeypatch.setattr(upserts, "COMPACT", 4)
    plain, ordered = KeyedTable(spark, f"{tmp_path}/p", ["k"]), KeyedTable(spark, f"{tmp_path}/o", ["k"], ("t",))
    with pytest.raises(ValueError, match="no rows yet"):
        plain.read()
    assert plain.read("k int, t int").count() == 0
    rng, by_commit, by_time = random.Random(3), {}, {}
    for batch in range(9):
        rows = [(k, rng.randrange(1000)) for k in rng.sample(range(20), 6)] + [(None, batch)]
        df = spark.createDataFrame(rows, "k int, t int")
        assert plain.merge(df, batch) and ordered.merge(df, batch)
        assert not plain.merge(df.withColumn("t", F.lit(-1)), batch)
        by_commit |= dict(rows)
        by_time |= {k: max(t, by_time.get(k, t)) for k, t in rows}
    assert {r.k: r.t for r in plain.read().collect()} == by_commit
    assert {r.k: r.t for r in ordered.read().collect()} == by_time
    assert len(plain.last()["parts"]) < 4
    assert plain.vacuum() > 0 and {r.k: r.t for r in plain.read().collect()} == by_commit
    stale = plain.last()
    plain.merge(spark.createDataFrame([(1, 5)], "k int, t int"))
    with pytest.raises(RuntimeError, match="already"):
        plain._commit(stale | {"version": stale["version"] + 1})


def batches(spark, tmp_path, name, schema, *parts):
    """A stream that takes each part, in order, as a batch of its own."""
    import os

    path, seen = f"{tmp_path}/{name}", set()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in set(os.listdir(path)) - seen:
            os.utime(f"{path}/{f}", (0, 1_500_000_000 + i * 100))
            seen.add(f)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


BASE = 1704067200


def test_silent_nodes_go_offline_by_a_timer(spark, tmp_path):
    stream = batches(spark, tmp_path, "in", "node long, ts timestamp", [(1, at(0)), (2, at(10)), (2, at(30))], [(2, at(200))], [(3, at(230)), (2, at(260)), (2, at(320))])
    got = sorted((r.node, r.at - BASE, r.state) for r in streams.run(spark, T.liveness(stream, 60)).collect())
    assert got == [(1, 0, "online"), (1, 60, "offline"), (2, 10, "online"), (2, 90, "offline"), (2, 200, "online"), (3, 230, "online"), (3, 290, "offline")]


def test_a_node_comes_back(spark, tmp_path):
    stream = batches(spark, tmp_path, "in", "node long, ts timestamp", [(1, at(0)), (9, at(100))], [(9, at(300)), (1, at(310))], [(9, at(320))])
    got = sorted((r.at - BASE, r.state) for r in streams.run(spark, T.liveness(stream, 60)).where("node = 1").collect())
    assert got == [(0, "online"), (60, "offline"), (310, "online")]


def test_chunk_streams_end(spark, tmp_path):
    done, error = '{"__done__": true, "summary": {"n": 3}}', '{"__done__": true, "__error__": "bad"}'
    rows = [(1, 0, at(0), '{"a":1}'), (1, 1, at(5), "not json"), (1, 2, at(9), done), (1, 3, at(10), '{"late":1}')]
    rows += [(2, 0, at(0), "[1]"), (2, 1, at(3), error)] + [(3, 0, at(0), "{}"), (3, 1, at(50), "{}")]
    rows += [(4, i, at(i * 20), "{}") for i in range(8)] + [(5, i, at(i), "{}") for i in range(7)]
    later = [(6, 0, at(500), "{}")]
    stream = batches(spark, tmp_path, "in", "stream_id long, seq long, ts timestamp, raw string", rows, later)
    kwargs = {"idle": 30, "total": 100, "max_chunks": 6}
    got = sorted((r.stream_id, -1 if r.seq is None else r.seq, r.status, r.payload, tuple((r.summary or {}).items())) for r in streams.run(spark, T.chunks(stream, **kwargs)).collect())
    batch = spark.createDataFrame([*rows, *later], "stream_id long, seq long, ts timestamp, raw string")
    twin = sorted((r.stream_id, -1 if r.seq is None else r.seq, r.status, r.payload, tuple((r.summary or {}).items())) for r in T.chunks_batch(batch, F.lit(BASE + 500), **kwargs).collect())
    assert got == [
        (1, 0, "chunk", '{"a":1}', ()), (1, 1, "chunk", '{"__raw__":"not json"}', ()), (1, 2, "completed", None, (("n", "3"),)),
        (2, 0, "chunk", '{"__raw__":"[1]"}', ()), (2, 1, "failed", "bad", ()), (3, -1, "failed", "idle", ()), (3, 0, "chunk", "{}", ()),
        (4, -1, "failed", "timeout", ()), *((4, i, "chunk", "{}", ()) for i in range(6)), (5, -1, "failed", "too many chunks", ()), *((5, i, "chunk", "{}", ()) for i in range(6)), (6, 0, "chunk", "{}", ()),
    ]
    assert twin == got


@pytest.mark.parametrize("name", ["breaker", "client_breaker", "health"])
def test_streaming_folds_equal_batch_folds(spark, tmp_path, name):
    rng = random.Random(5)
    rows = sorted([(rng.randrange(6), at(rng.randrange(4000)), i, rng.random() < 0.5) for i in range(300)], key=lambda r: r[1])
    schema = "entity long, ts timestamp, id long, ok boolean"
    parts = [rows[i : i + 75] for i in range(0, 300, 75)]
    batch = spark.createDataFrame(rows, schema)
    build = {"breaker": lambda s: T.breaker(s, 2, 60.0), "client_breaker": lambda s: T.client_breaker(s, 2, 30.0), "health": T.health}[name]
    twin = {"breaker": lambda d: fsm.breaker_timeline(d, "entity", 2, 60.0), "client_breaker": lambda d: fsm.client_breaker_timeline(d, "entity", 2, 30.0), "health": lambda d: fsm.health_state(d, "entity", "ok", ["ts", "id"])}[name](batch)
    got = streams.run(spark, build(batches(spark, tmp_path, "in", schema, *parts)))
    assert sorted(got.collect()) == sorted(twin.select(*got.columns).collect())


def test_node_machine_stream_equals_batch(spark):
    from opstables.plans import catalog

    got = catalog.QUERIES["t6_node_machine"](spark, SMALL)
    want = catalog.QUERIES["e16_node_fsm"](spark, SMALL).select(*got.columns)
    assert got.count() > 0 and sorted(got.collect()) == sorted(want.collect())


def test_repeats_within_the_delay_are_dropped_and_later_ones_are_not(spark, tmp_path):
    stream = batches(spark, tmp_path, "in", "k long, ts timestamp", [(1, at(0)), (1, at(1))], [(1, at(200)), (2, at(800))], [(9, at(900))], [(1, at(1000))])
    got = sorted((r.k, r.ts) for r in streams.run(spark, T.deduplicated(stream, "ts", ["k"])).collect())
    assert [k for k, _ in got] == [1, 1, 2, 9]


def test_stuck_actions_are_deduplicated(spark, tmp_path):
    """A task is acted on once in 300 s, by the stream's own record of its actions, and again later."""
    schema = "task_id bigint, capability string, status string, priority_rank int, attempt int, max_retries int, created_at timestamp"
    stuck = [(i, "c", "running", 1, 0, 2, at(0)) for i in range(5)]
    stream = batches(spark, tmp_path, "in", schema, [*stuck, stuck[0]], stuck, stuck)
    clock = iter(["2024-01-01 01:00:00", "2024-01-01 01:04:00", "2024-01-01 01:06:00"])
    leases = spark.createDataFrame([(3,)], "task_id bigint")
    actions = KeyedTable(spark, f"{tmp_path}/actions", ["task_id"])
    seen = lambda: spark.createDataFrame([(4,)], "task_id bigint")
    counts, merge = [], actions.merge
    actions.merge = lambda df, n: (counts.append(sorted(r.task_id for r in df.collect())), merge(df, n))
    drained(T.stuck_actions(stream, leases, lambda: next(clock), actions, seen), tmp_path / "c")
    assert counts == [[0, 1, 2], [], [0, 1, 2]]


def test_a_part_of_many_files_is_one_batch(spark, monkeypatch, tmp_path):
    """No task writes or reads a whole batch, and the batches come in order, an empty one too."""
    parts = [spark.range(1000).repartition(3), spark.range(0).repartition(1), spark.range(500, 2000).repartition(5)]
    seen = []
    streams._in_batches(spark, str(tmp_path), lambda s: s.writeStream.foreachBatch(lambda df, n: seen.append((n, df.rdd.getNumPartitions() > 1, df.count()))), *parts)
    assert [(n, rows) for n, _, rows in seen] == [(0, 1000), (1, 0), (2, 1500)] and seen[0][1] and seen[2][1]


def test_tables_of_many_parts_are_not_sorted_before_the_shuffle(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"])
    for n in range(3):
        table.merge(spark.range(n, 10).selectExpr("id", f"'{n}' AS v"))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(id") > plan.rindex("Sort") and plan.count("Exchange") == 1
    assert {(r.id, r.v) for r in table.read().collect()} == {(i, str(min(i, 2))) for i in range(10)}


def test_dead_letters_are_retained_for_30_days(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2023, 12, 1))], "id int, died_at timestamp")
    assert [r.id for r in T.retained_dead_letters(rows, "2024-01-05 00:00:00").collect()] == [1]


def test_cron_ticks_fire_once_and_move_on(spark, tmp_path):
    schema = "schedule_id bigint, tenant_id string, enabled boolean, next_fire_at string, cron_expr string"
    table = [(1, "t", True, "2024-01-01T00:00:00", "*/10 * * * *"), (2, "t", True, None, "* * * * *"), (3, "t", False, "2024-01-01T00:00:00", "* * * * *"), (4, "t", True, "2024-01-01T00:01:00", "0 0 31 2 *")]
    schedules, fired = KeyedTable(spark, f"{tmp_path}/schedules", ["schedule_id"]), KeyedTable(spark, f"{tmp_path}/fired", ["idempotency_key"])
    schedules.merge(spark.createDataFrame(table, schema))
    stream = batches(spark, tmp_path, "in", "timestamp timestamp", [(at(60 * m),) for m in range(3)], [(at(180),)], [(at(600),)])
    drained(T.cron_ticks(stream, schedules, fired), tmp_path / "c")
    assert sorted((r.schedule_id, r.idempotency_key) for r in fired.read().collect()) == [(1, "cron:1:1704067320"), (1, "cron:1:1704067800"), (4, "cron:4:1704067320")]
    assert {r.schedule_id: r.next_fire_at for r in schedules.read().collect()} == {1: "2024-01-01T00:20:00", 2: None, 3: "2024-01-01T00:00:00", 4: None}


def test_declared_tables(spark, tmp_path):
    path = str(tmp_path / "beats")
    beats = spark.createDataFrame([("n1", datetime.datetime(2024, 1, 1))], "node_id string, ts timestamp")
    tables.append_events(beats, path)
    tables.append_events(beats, path)
    assert tables.read_table(spark, "heartbeats", path).count() == 2
    assert tables.stream_table(spark, "heartbeats", path).isStreaming


@pytest.mark.parametrize("pieces", [2, 16])
def test_split_rank_with_a_hot_key_and_ties(spark, pieces):
    rows = [("hot", i % 37, i) for i in range(2000)] + [("cold", 5, 1), ("cold", 3, 2)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {(r.k, r.id): (r.n, r.n_of) for r in ranks.split_rank(df, ["k"], "v", ["id"], "n", pieces).collect()}
    for key in ("hot", "cold"):
        order = sorted((v, i) for k, v, i in rows if k == key)
        assert all(got[key, i] == (n, len(order)) for n, (_, i) in enumerate(order, 1))


@pytest.mark.parametrize("name", ["breaker", "client_breaker", "health", "limiter", "machine"])
def test_rows_in_any_order_within_the_delay(spark, tmp_path, name):
    """Each row comes up to 300 s after rows of its own time: what is given equals the batch twin's result."""
    rng = random.Random(17)
    events = ["enqueue", "start", "complete", "fail", "requeue", "none"]
    rows = [(rng.randrange(5), at(rng.randrange(4000)), i, rng.random() < 0.5, rng.choice(events)) for i in range(400)]
    came = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, 300)))
    assert came != sorted(rows, key=lambda r: r[1])
    schema = "entity long, ts timestamp, id long, ok boolean, event string"
    stream = batches(spark, tmp_path, "in", schema, *(came[i : i + 100] for i in range(0, 400, 100)), [(99, at(10_000), 1, True, "none")])
    batch = spark.createDataFrame(rows, schema)
    as_tasks = lambda df: df.withColumnsRenamed({"entity": "task_id", "ts": "created_at"})
    late = "301 seconds"
    got, want = {
        "breaker": lambda: (T.breaker(stream, 2, 60.0, late), fsm.breaker_timeline(batch, "entity", 2, 60.0)),
        "client_breaker": lambda: (T.client_breaker(stream, 2, 30.0, late), fsm.client_breaker_timeline(batch, "entity", 2, 30.0)),
        "health": lambda: (T.health(stream, delay=late), fsm.health_state(batch, "entity", "ok", ["ts", "id"])),
        "limiter": lambda: (T.limiter(stream, 60, 2, late), fsm.rate_limit(batch, "entity", 60, 2)),
        "machine": lambda: (T.machine(as_tasks(stream), fsm.TASK_TABLE, "pending", late), fsm.replay_fsm(as_tasks(batch), "task_id")),
    }[name]()
    found = streams.run(spark, got)
    key = found.columns[0]
    assert sorted(found.where(f"{key} <> 99").collect()) == sorted(want.select(*got.columns).collect())


def test_liveness_and_alerts_in_any_order(spark, tmp_path):
    rng = random.Random(18)
    beats = [(rng.randrange(4), at(rng.randrange(5000))) for _ in range(120)]
    came = sorted(beats, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, 200)))
    stream = batches(spark, tmp_path, "beats", "node long, ts timestamp", *(came[i : i + 30] for i in range(0, 120, 30)), [(99, at(20_000))])
    got = streams.run(spark, T.liveness(stream, 60, "201 seconds")).where("node <> 99")
    want = T.liveness_batch(spark.createDataFrame(beats, "node long, ts timestamp"), 60, F.lit((BASE + 19_000) * 1_000_000))
    assert sorted((r.node, r.at, r.state) for r in got.collect()) == sorted((r.node, r.at / 1e6, r.state) for r in want.collect())

    evals = [("a", at(t), (t // 100) % 3 < 2) for t in range(0, 3000, 10)]
    came = sorted(evals, key=lambda r: r[1] + datetime.timedelta(seconds=rng.uniform(0, 200)))
    stream = batches(spark, tmp_path, "evals", "labels string, ts timestamp, on boolean", *(came[i : i + 60] for i in range(0, 300, 60)), [("z", at(20_000), False)])
    got = sorted((r.at - BASE, r.state) for r in streams.run(spark, T.alert_lifecycle(stream, 50, "201 seconds")).where("labels = 'a'").collect())
    assert got == sorted(x for t in range(0, 3000, 300) for x in ((t, "pending"), (t + 50, "firing"), (t + 200, "resolved")) if x[0] < 3000)


def test_a_hot_key_of_a_stream_is_read_by_slots(spark, tmp_path, monkeypatch):
    from opstables.streaming import state

    n = 60_000
    rows = spark.range(n).selectExpr("CAST(1 AS BIGINT) AS entity", f"timestamp_seconds({BASE} + (id * 7919) % {n}) AS ts", "id", "id % 3 <> 0 AS ok").repartition(3)
    rows.write.parquet(str(tmp_path / "hot"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "hot"))
    got = streams.run(spark, T.breaker(stream, 3, 20.0))
    assert n / state.SLOT_SECONDS == 100  # slots, read one by one
    want = fsm.breaker_timeline(rows, "entity", 3, 20.0)
    assert got.count() == n and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_late_rows_are_dropped_and_state_goes(spark, tmp_path):
    schema = "entity long, ts timestamp, id long, ok boolean"
    stream = batches(spark, tmp_path, "in", schema, [(1, at(0), 1, False), (1, at(100), 2, False)], [(2, at(5000), 4, True)], [(1, at(10), 3, False)], [(1, at(6000), 5, False)])
    got = sorted((r.id, r.state, r.failures) for r in streams.run(spark, T.breaker(stream, 3, 60.0)).collect())
    assert got == [(1, "closed", 1), (2, "closed", 2), (4, "closed", 0), (5, "closed", 1)]


def test_windows_rules_and_alerts_in_one_query(spark, tmp_path):
    """20 batches: a busy minute in three fires by its count; rows within the delay count in their window, later ones don't; the state stays small."""
    schema = "label string, ts timestamp"
    minutes = range(0, 60)
    parts = []
    for k in range(20):
        own = [m for m in minutes if m // 3 == k]
        parts.append([("a", at(m * 60 + i * 5)) for m in own for i in range(8 if m % 6 < 4 else 1)] + ([("a", at(own[0] * 60 - 30))] if k else []))
    parts[10].append(("a", at(0)))  # far too late, in a busy minute that was told long ago
    parts.append([(None, at(90_000))])
    stream = batches(spark, tmp_path, "in", schema, *parts)
    out = T.alert_changes(stream, "ts", ["label"], {"n": F.count("*")}, [("Busy", "n > 5", 120, "warning"), ("Never", "n > 1000", 0, "info")], "1 minute", delay="2 minutes")
    base = str(tmp_path / "out")
    q = out.writeStream.format("parquet").option("checkpointLocation", base + "-c").trigger(availableNow=True).start(base)
    q.awaitTermination()
    assert q.exception() is None
    got = sorted((r.at - BASE, r.label, r.alertname, r.severity, r.state) for r in spark.read.parquet(base).collect())
    want = [(t, "a", "Busy", "warning", s) for m in range(0, 60, 6) for t, s in ((m * 60 + 60, "pending"), (m * 60 + 180, "firing"), (m * 60 + 300, "resolved"))]
    assert got == sorted(want)
    progress = [p for p in q.recentProgress if p.stateOperators]
    assert len(progress) >= 20 and all(op.numRowsTotal <= 12 for p in progress for op in p.stateOperators)
    assert sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators) >= 1


def test_a_key_of_a_fold_takes_few_calls_of_the_state(spark):
    """Each is a message to the JVM and back: a key whose rows wait once and are folded at its timer takes five, and gives no empty frames."""
    from pyspark.sql.types import BooleanType, LongType, StructType

    from opstables.streaming.state import OrderedFold

    calls = []

    class Handle:
        """A handle of one key: values and maps in dictionaries."""

        def getValueState(self, name, schema):
            return Value(name)

        def getMapState(self, name, key, schema):
            return Map(name)

        def registerTimer(self, at):
            calls.append(("timer", at))

        def deleteTimer(self, at):
            calls.append(("no timer", at))

    class Value:
        def __init__(self, name):
            self.name, self.held = name, None

        def exists(self):
            calls.append((self.name, "exists"))
            return self.held is not None

        def get(self):
            calls.append((self.name, "get"))
            return self.held

        def update(self, held):
            calls.append((self.name, "update"))
            self.held = held

        def clear(self):
            calls.append((self.name, "clear"))
            self.held = None

    class Map(Value):
        def __init__(self, name):
            self.name, self.held = name, {}

        def keys(self):
            calls.append((self.name, "keys"))
            return iter(self.held)

        def getValue(self, key):
            calls.append((self.name, "get"))
            return self.held[key]

        def updateValue(self, key, held):
            calls.append((self.name, "update"))
            self.held[key] = held

        def removeKey(self, key):
            calls.append((self.name, "remove"))
            del self.held[key]

    class Timers:
        def __init__(self, mark):
            self.getCurrentWatermarkInMs = lambda: mark

    given = StructType.fromDDL("entity long, " + fsm.BREAKER_ROWS)
    one = OrderedFold({"us": LongType(), "id": LongType(), "ok": BooleanType()}, given, fsm.breaker_step(2, 60.0), fsm.BREAKER_START, "failures int, failed double, until double", lambda s: None, lambda s: (None, []))
    one.init(Handle())
    frame = pd.DataFrame({"us": [3_000_000, 1_000_000, 2_000_000], "id": [3, 1, 2], "ok": [False, True, False]})
    assert list(one.handleInputRows((7,), iter([frame]), Timers(0))) == []
    got = list(one.handleExpiredTimer((7,), Timers(10_000), None))
    assert [f.values.tolist() for f in got] == [[[7, 1, "closed", 0], [7, 2, "closed", 1], [7, 3, "open", 0]]]
    assert len(calls) == 5, calls
