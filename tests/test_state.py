"""Hand tables and Python models for the operators that fold state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from opstables.operators import alerts, dag, fsm, queue, udf
from opstables.sources import tables

START = datetime.datetime(2024, 1, 1)


def events(spark, key, rows):
    """rows: (seconds, value)"""
    data = [(key, i, START + datetime.timedelta(seconds=s), v) for i, (s, v) in enumerate(rows)]
    return data


def outcomes(spark, *groups):
    data = [r for key, rows in enumerate(groups) for r in events(spark, key, rows)]
    return spark.createDataFrame(data, "entity bigint, id bigint, ts timestamp, ok boolean")


def by_id(df, key, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], {})[r["id"]] = tuple(r[c] for c in cols)
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_breaker_opens_ignores_and_recovers(spark):
    rows = [(0, False), (1, False), (2, False), (3, True), (70, False), (71, True), (72, False), (73, False)]
    got = by_id(fsm.breaker_timeline(outcomes(spark, rows), "entity", threshold=3, open_s=60), "entity", "state", "failures")[0]
    assert got == [("closed", 1), ("closed", 2), ("open", 0), ("open", 0), ("closed", 1), ("closed", 0), ("closed", 1), ("closed", 2)]


def test_breaker_forgets_failures(spark):
    got = by_id(fsm.breaker_timeline(outcomes(spark, [(0, False), (50, False)]), "entity", threshold=2, open_s=10), "entity", "state")[0]
    assert got == [("closed",), ("closed",)]


def test_client_breaker(spark):
    rows = [(0, False), (1, False), (10, True), (40, True), (41, False), (42, False), (80, False), (81, True)]
    got = by_id(fsm.client_breaker_timeline(outcomes(spark, rows), "entity", threshold=2, reset_s=30), "entity", "allowed", "state")[0]
    assert got == [(True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed"), (True, "open"), (True, "open"), (False, "open")]


def model_limiter(seconds, window, most, collapse):
    held, out = [], []
    for t in seconds:
        held = [x for x in held if x > t - window]
        if len(held) < most:
            out.append((True, most - len(held) - 1, 0))
            if not (collapse and t in held):
                held.append(t)
        else:
            out.append((False, 0, max(1, min(held) + window - t)))
    return out


@pytest.mark.parametrize("collapse", [True, False])
def test_limiter_equals_model(spark, collapse):
    rng = random.Random(3)
    groups = [sorted(rng.randrange(200) for _ in range(60)) for _ in range(4)]
    df = outcomes(spark, *[[(s, True) for s in g] for g in groups])
    got = by_id(fsm.rate_limit(df, "entity", window=30, most=4, collapse_same_second=collapse), "entity", "allowed", "remaining", "retry_after")
    for k, g in enumerate(groups):
        assert got[k] == model_limiter(g, 30, 4, collapse)


def model_health(oks, unhealthy, healthy):
    status, ok_n, bad_n, out = "healthy", 0, 0, []
    for ok in oks:
        ok_n, bad_n = (ok_n + 1, 0) if ok else (0, bad_n + 1)
        if status != "healthy" and ok_n >= healthy:
            status = "healthy"
        elif status == "healthy" and bad_n >= 2:
            status = "degraded"
        elif status == "degraded" and bad_n >= unhealthy:
            status = "unhealthy"
        out.append((status,))
    return out


@pytest.mark.parametrize(("unhealthy", "healthy"), [(3, 1), (3, 2), (4, 3)])
def test_health_closed_form_equals_model(spark, unhealthy, healthy):
    rng = random.Random(unhealthy * 10 + healthy)
    groups = [[rng.random() < 0.5 for _ in range(40)] for _ in range(25)]
    df = outcomes(spark, *[list(enumerate(g)) for g in groups])
    got = by_id(fsm.health_state(df, "entity", "ok", ["ts", "id"], unhealthy, healthy), "entity", "status")
    for k, g in enumerate(groups):
        assert got[k] == model_health(g, unhealthy, healthy)
    with pytest.raises(ValueError):
        fsm.health_state(df, "entity", "ok", ["ts"], unhealthy=2)


def test_concurrency_timeline(spark):
    got = by_id(fsm.concurrency_timeline(outcomes(spark, [(i, ok) for i, ok in enumerate([False] * 3 + [True] * 4)]), "entity", baseline=3), "entity", "max_concurrent")[0]
    assert [x for (x,) in got] == [2, 1, 1, 2, 3, 3, 3]


def test_fsm_ignores_illegal_events(spark):
    names = ["enqueue", "complete", "start", "requeue", "start", "complete", "fail"]
    data = [(0, i, START + datetime.timedelta(seconds=i), n) for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "task_id bigint, id bigint, created_at timestamp, event string")
    got = by_id(fsm.replay_fsm(df, "task_id"), "task_id", "next", "legal")[0]
    assert got == [("queued", True), ("queued", False), ("running", True), ("queued", True), ("running", True), ("completed", True), ("completed", False)]


def test_waves_with_cycle_and_unknown(spark):
    steps = spark.createDataFrame([(s,) for s in "abcdxyz"], "step string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "nowhere"), ("d", "z")], "step string, depends_on string")
    got = {r.step: r.wave for r in dag.waves(steps, edges).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": None, "x": None, "y": None, "z": None}
    problems = {(r.step, r.problem) for r in dag.check_dag(steps, edges).collect()}
    assert problems == {("z", "unknown dependency"), ("x", "cycle"), ("y", "cycle"), ("d", "blocked")}


def test_waves_of_long_chains(spark):
    """2,000 steps in a row, and a comb of them, take rounds by the logarithm of the chain, not by its length."""
    import time

    chain = [(i, i - 1) for i in range(1, 2000)]
    comb = [(5000, 1500), (5000, 700), (5001, 5000), (5002, 5001), (5002, 1999)]
    edges = spark.createDataFrame(chain + comb, "step bigint, depends_on bigint")
    steps = edges.select("step").union(edges.select("depends_on")).distinct()
    began = time.perf_counter()
    got = {r.step: r.wave for r in dag.waves(steps, edges).collect()}
    assert got == {**{i: i + 1 for i in range(2000)}, 5000: 1502, 5001: 1503, 5002: 2001}
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize("seed", [1, 2])
def test_cycle_steps_by_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)} | {(100, 101), (101, 102), (102, 100), (103, 100), (101, 104), (104, 105), (105, 104), (106, 106), (None, 3)}
    reach = {}
    for _ in range(60):
        reach = {s: {d for a, d in edges if a == s} | set().union(*(reach.get(d, set()) for a, d in edges if a == s)) for s, _ in edges}
    want = {s for s in reach if s in reach[s]}
    assert {100, 101, 102, 104, 105, 106} <= want and 103 not in want
    got = [r.step for r in dag.cycle_steps(spark.createDataFrame(list(edges), "step bigint, depends_on bigint")).collect()]
    assert sorted(got) == sorted(want)


def test_ready_steps_by_brute_force(spark):
    rng = random.Random(4)
    deps = {s: sorted({rng.randrange(s) for _ in range(rng.randrange(1, 4))}) if s % 9 else [] for s in range(120)}
    runs = {r: (sorted({x for s in rng.sample(range(120), 25) for x in [s, *deps[s]]}), rng.sample(range(120), 5)) for r in range(20)} | {99: ([], [])}
    want = {(r, s) for r, (c, f) in runs.items() for s, d in deps.items() if set(d) <= set(c) and s not in c and s not in f}
    steps = spark.createDataFrame(list(deps.items()), "step bigint, depends array<bigint>")
    progress = spark.createDataFrame([(r, c, f) for r, (c, f) in runs.items()], "run_id bigint, completed array<bigint>, failed array<bigint>")
    found = dag.ready_steps(steps, progress)
    assert sorted((r.run_id, r.step) for r in found.collect()) == sorted(want)
    assert any(s > 60 and deps[s] for _, s in want)


def test_first_steps_are_paired_either_way(spark, monkeypatch):
    steps = spark.createDataFrame([(s,) for s in range(6)], "step bigint")
    edges = spark.createDataFrame([(3, 0), (4, 1), (4, 2)], "step bigint, depends_on bigint")
    runs = spark.createDataFrame([(1,), (2,), (2,)], "run_id bigint")
    done, failed = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 2)], "run_id bigint, step bigint"), spark.createDataFrame([(2, 5)], "run_id bigint, step bigint")
    for bound in (1_000, 0):
        monkeypatch.setattr(dag, "FIRST_STEPS", bound)
        found = dag.ready_after(steps, edges, runs, done, failed)
        assert sorted((r.run_id, r.step) for r in found.collect()) == [(1, 2), (1, 3), (1, 5), (2, 0), (2, 4)]
        if bound:
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_rows_of_runs_are_joined_by_a_step_once(spark):
    steps = spark.createDataFrame([(s,) for s in (0, 1, 2, 3, None)], "step bigint")
    edges = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (3, 0), (3, None), (None, 0), (9, 0)], "step bigint, depends_on bigint")
    runs = spark.createDataFrame([(1,), (2,)], "run_id bigint")
    done, failed = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0)], "run_id bigint, step bigint"), spark.createDataFrame([], "run_id bigint, step bigint")
    found = dag.ready_after(steps.where("step IS NOT NULL"), edges, runs, done, failed)
    assert sorted((r.run_id, r.step) for r in found.collect()) == [(1, 2), (2, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_cluster_choice_by_brute_force(spark):
    from opstables.operators import registry

    rng = random.Random(2)
    clusters = [(i, rng.choice(["active", "active", "offline"]), rng.randrange(9), rng.randrange(4), rng.choice(["", "a", "b", None]), rng.choice([[], ["x"], ["x", "y"], None])) for i in range(25)]
    requests = [(i, rng.choice([0, -1, 3, 8, 9, None]), rng.choice(["a", "b", "c", "", None]), rng.choice(["x", "y", "z", "", None])) for i in range(80)]
    want = {}
    for i, gpus, tenant, cap in requests:
        fit = [(-g, -c, n) for n, state, g, c, t, can in clusters if state == "active" and ((gpus or 0) <= 0 or g >= gpus) and (not cap or cap in (can or [])) and (not tenant or (t or "") in ("", tenant))]
        want[i] = min(fit)[2] if fit else None
    c = spark.createDataFrame(clusters, "cluster_id bigint, status string, available_gpus int, available_cpus int, tenant_id string, capabilities array<string>")
    r = spark.createDataFrame(requests, "request_id int, gpus int, tenant_id string, capability string")
    assert {x.request_id: x.cluster_id for x in registry.select_cluster(r, c).collect()} == want


def test_ready_steps_reach_the_whole_graph(spark):
    from opstables.plans import catalog

    found = catalog.QUERIES["i2_ready_steps_runs"](spark, "/root/testdata/sf0.001")
    assert found.agg(F.max("step")).first()[0] > 60 and found.select("run_id").distinct().count() > 25


def test_skipped_polls_lose_no_ticks(spark):
    rng = random.Random(8)
    ticks = [(rng.randrange(4), rng.randrange(-50, 1000)) for _ in range(300)] + [(7, 100), (7, 101), (7, 2000)]
    for polls in ([100, 130, 131, 400, 950], [333], [-100, 1005]):
        want = {}
        for s, t in ticks:
            if later := [p for p in polls if p >= t]:
                want.setdefault((s, min(later)), []).append(t)
        found = fsm.coalesce_to_polls(spark.createDataFrame(ticks, "schedule_id bigint, t bigint"), spark.createDataFrame([(p,) for p in polls], "poll_at bigint"), 10)
        got = {(r.schedule_id, r.poll_at): (r.fire_at, r.missed) for r in found.collect()}
        assert got == {k: (max(v), len(v) - 1) for k, v in want.items()}


def test_whole_tables_are_read(spark):
    from opstables.plans import catalog, fixtures

    small = "/root/testdata/sf0.001"
    kept = {r.id for r in catalog.QUERIES["c12_inhibit_all"](spark, small).collect()}
    firing = fixtures.view(spark, small, "alerts").where("status = 'firing'").collect()
    critical, down = {(r.alertname, r.service) for r in firing if r.severity == "critical"}, {r.service for r in firing if r.alertname == "ServiceDown"}
    assert kept == {r.id for r in firing if not (r.severity == "warning" and (r.alertname, r.service) in critical) and not (r.alertname != "ServiceDown" and r.service in down)}
    assert catalog.QUERIES["s4_first_available_all"](spark, small).count() == fixtures.view(spark, small, "tasks").count()
    due = catalog.QUERIES["e23_coalesce_ticks_all"](spark, small).agg(F.sum("missed"), F.count("*"), F.max("poll_at")).first()
    assert due[0] + due[1] == fixtures.view(spark, small, "health_checks").where(F.unix_seconds("ts") <= due[2]).count()


def test_check_dag_by_brute_force(spark):
    from opstables.plans import catalog

    rng = random.Random(6)
    edges = {(s, rng.randrange(s)) for s in range(1, 60) for _ in range(2)} | {(20, 41), (41, 30), (30, 20), (55, 500)}
    names = list(range(60))
    stuck, good = set(names), set()
    while ready := {s for s in stuck if all(d in good for a, d in edges if a == s)}:
        good |= ready
        stuck -= ready
    reach = {s: {d for a, d in edges if a == s} for s in names}
    for _ in names:
        reach = {s: ds | set().union(*(reach.get(d, set()) for d in ds)) for s, ds in reach.items()}
    cycle = {s for s in names if s in reach[s]}
    assert {20, 30, 41} <= cycle < stuck
    want = {(3, "duplicate step"), (55, "unknown dependency")} | {(s, "cycle" if s in cycle else "blocked") for s in stuck - {55}}
    got = dag.check_dag(spark.createDataFrame([(s,) for s in [*names, 3]], "step bigint"), spark.createDataFrame(sorted(edges), "step bigint, depends_on bigint")).collect()
    assert sorted((r.step, r.problem) for r in got) == sorted(want) and len(want) > 5
    found = catalog.QUERIES["i9_check_dag_all"](spark, "/root/testdata/sf0.001")
    assert found.where("problem = 'cycle'").count() > 0


def test_rounds_of_graphs_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df, label, stored=dag.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(dag, "stored", kept)
    edges = spark.createDataFrame([(i, j) for i in range(1, 40) for j in {i // 2, i // 3}] + [(20, 40), (40, 20)], "step bigint, depends_on bigint")
    names = edges.select("step").union(edges.select("depends_on")).distinct()
    found = [dag.waves(names, edges), dag.check_dag(names, edges), dag.lineage(edges.where("step < 40").groupBy("step").agg(F.max("depends_on").alias("d")), "step", "d")]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in found]
    assert len(plans) > 20 and sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_lineage_chain(spark):
    edges = spark.createDataFrame([(i, i - 1 if i % 50 else None) for i in range(200)], "id bigint, from_id bigint")
    got = {r.node: (r.root, r.depth) for r in dag.lineage(edges).collect()}
    assert got == {i: (i // 50 * 50, i % 50) for i in range(200)}


def test_lineage_of_cycles(spark):
    parents = {1: 3, 2: 1, 3: 2, 4: 4, 5: 4, 6: 3, 7: None, 8: 7, 9: 77, 10: 9}
    edges = spark.createDataFrame(list(parents.items()), "id bigint, from_id bigint")
    got = {r.node: (r.root, r.depth) for r in dag.lineage(edges).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 5, 6), (None, None)), 7: (7, 0), 8: (7, 1), 9: (77, 1), 10: (77, 2)}


def test_a_hot_key_is_folded_in_time(spark):
    import time

    df = spark.range(200_000).selectExpr("CAST(id % 100 = 99 AS bigint) AS entity", "id", "timestamp_seconds(1704067200 + id) AS ts", "id % 3 <> 0 AS ok")
    began = time.perf_counter()
    assert fsm.breaker_timeline(df, "entity", 3, 20.0).where("state = 'closed'").count() > 0
    assert fsm.rate_limit(df, "entity", 60, 10).where("allowed").count() > 30_000
    assert time.perf_counter() - began < 60


def test_folds_of_an_empty_table_and_null_keys(spark):
    empty = spark.createDataFrame([], "entity bigint, id bigint, ts timestamp, ok boolean")
    assert fsm.breaker_timeline(empty, "entity").count() == 0
    rows = spark.createDataFrame([(None, 1, START, False), (None, 2, START, None), (5, 3, START, False)], empty.schema)
    got = {(r.entity, r.id): (r.state, r.failures) for r in fsm.breaker_timeline(rows, "entity", threshold=2).collect()}
    assert got == {(None, 1): ("closed", 1), (None, 2): ("open", 0), (5, 3): ("closed", 1)}


def test_health_step_equals_closed_form_and_any_threshold(spark):
    rng = random.Random(2)
    oks = [rng.random() < 0.5 for _ in range(60)]
    for unhealthy, healthy in ((3, 2), (2, 1), (5, 3)):
        state, out = fsm.HEALTH_START, []
        for i, ok in enumerate(oks):
            state, rows = fsm.health_step(unhealthy, healthy)(state, i, i, ok)
            out += [(s,) for _, s in rows]
        assert out == model_health(oks, unhealthy, healthy)


def test_node_machine(spark):
    names = ["reserve", "join", "offline", "join", "release", "reserve"]
    df = spark.createDataFrame([(0, i, START + datetime.timedelta(seconds=i), n) for i, n in enumerate(names)], "task_id bigint, id bigint, created_at timestamp, event string")
    got = by_id(fsm.replay_fsm(df, "task_id", fsm.NODE_TABLE, "idle"), "task_id", "next", "legal")[0]
    assert got == [("reserved", True), ("joined", True), ("offline", True), ("offline", False), ("idle", True), ("reserved", True)]


def test_scale_advice(spark):
    rows = [("a", t, u) for t, u in [(0, 0.9), (100, 0.95), (300, 0.9), (500, 0.1), (700, 0.1), (1000, 0.5)]] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "capability string, t bigint, utilization double")
    got = {r.t: (r.advice, r.delta) for r in fsm.scale_advice(df, "capability").collect()}
    assert got == {0: ("up", 1), 100: ("hold", 0), 300: ("up", 1), 500: ("hold", 0), 700: ("down", -1), 1000: ("hold", 0)}


def test_backoff_by_hand(spark):
    from opstables.plans import catalog, fixtures

    rows = catalog.QUERIES["f6_backoff"](spark, "/root/testdata/sf0.001").collect()
    attempts = {r.id: r.attempt_count for r in fixtures.view(spark, "/root/testdata/sf0.001", "callback_outbox").collect()}
    assert len(rows) == len(attempts) and len({r.step_s for r in rows}) > 50  # jitter
    for r in rows:
        n = attempts[r.id]
        assert r.client_s == min(0.1 * 2**n, 30) and min(2**n, 60) <= r.step_s <= min(1.2 * 2**n, 60)


def test_requests_of_a_batch_share_a_new_key(spark):
    from opstables.operators import reconcile

    requests = spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (3, "t", "b"), (4, "u", "a"), (5, "t", None), (6, "t", None)], "request_id bigint, tenant_id string, idempotency_key string")
    tasks = spark.createDataFrame([(9, "t", "b", START)], "task_id bigint, tenant_id string, idempotency_key string, created_at timestamp")
    got = {r.request_id: (r.task_id, r.idempotent_reused) for r in reconcile.submit(requests, tasks).collect()}
    assert got[1][0] == got[2][0] and [got[i][1] for i in range(1, 7)] == [False, True, True, False, False, False] and got[3][0] == "9"


def test_next_fire_beyond_a_year_and_never(spark):
    from opstables.operators import schedule

    crons = {"0 0 29 2 *": "2028-02-29 00:00:00", "0 0 30 2 *": None, "30 12 1 3 *": "2024-03-01 12:30:00", "* * * * *": "2024-03-01 00:01:00", "0 0 1 3 *": "2025-03-01 00:00:00"}
    df = spark.createDataFrame([(c,) for c in crons], "cron string")
    got = {r.cron: None if r.next_fire_at is None else str(r.next_fire_at) for r in schedule.next_fire(df, "cron", "2024-03-01 00:00:00").collect()}
    assert got == crons
    far = schedule.next_fire(spark.createDataFrame([("0 0 29 2 *",)], "cron string"), "cron", "2096-03-01 00:00:00").first()
    assert str(far.next_fire_at) == "2104-02-29 00:00:00"


@pytest.mark.parametrize("most", [100_000, 1])
def test_next_fire_of_a_pattern_is_worked_out_once(spark, monkeypatch, most):
    from opstables.operators import ranks, schedule

    monkeypatch.setattr(ranks, "BROADCAST_ROWS", most)
    crons = spark.range(20_000).selectExpr("id", "element_at(array('0 0 30 2 *', '*/15 * * * *', NULL, '30 6 1 * *'), CAST(id % 4 + 1 AS INT)) AS cron")
    df = schedule.next_fire(crons, "cron", "2024-01-31 12:00:00")
    assert df.columns == ["id", "cron", "next_fire_at"] and "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.cron, str(r.next_fire_at), r["n"]) for r in df.groupBy("cron", "next_fire_at").agg(F.count("*").alias("n")).collect()}
    assert got == {("0 0 30 2 *", "None", 5000), ("*/15 * * * *", "2024-01-31 12:15:00", 5000), (None, "None", 5000), ("30 6 1 * *", "2024-02-01 06:30:00", 5000)}


def test_silences_beyond_the_broadcast_bound(spark, monkeypatch):
    rng = random.Random(1)
    pick = lambda *v: rng.choice(v)
    day = lambda d: START + datetime.timedelta(days=d)
    rows = [(i, pick("a", "b", None), pick("critical", "info", None), pick("x", "y"), day(rng.randrange(10))) for i in range(80)]
    quiet = [(i, pick("a", "b", None), pick("critical", "info", None), pick("x", "y", None), day(rng.randrange(8)), day(9)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, alertname string, severity string, service string, starts_at timestamp")
    s = spark.createDataFrame(quiet, "silence_id int, alertname string, severity string, service string, created_at timestamp, expires_at timestamp")
    want = {}
    for i, *labels, at in rows:
        hits = [q[0] for q in quiet if all(m is None or m == v for m, v in zip(q[1:4], labels, strict=True)) and q[4] <= at < q[5]]
        want[i] = min(hits, default=None)
    for bound in (10_000, 0):
        monkeypatch.setattr(alerts, "BROADCAST_SILENCES", bound)
        assert {r.id: r.silenced_by for r in alerts.apply_silences(df, s).collect()} == want


@pytest.mark.parametrize("pieces", [10**6, 30])
def test_as_of_by_brute_force(spark, monkeypatch, pieces):
    from opstables.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_A_PIECE", pieces)
    rng = random.Random(9)
    left = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([rng.randrange(500), 100, 480])) for i in range(300)]
    right = [(k, rng.choice([rng.randrange(100), 200 + rng.randrange(100)]), f"v{i}") for i, k in enumerate(rng.choices(["a", "c", None], k=80))]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())  # one row a key and time
    a, b = spark.createDataFrame(left, "k string, id int, t long"), spark.createDataFrame(right, "k string, t long, v string")
    for after in (False, True):
        got = {r.id: (r.at, r.v) for r in ordered.as_of(a, b, ["k"], "t", "t", {"v": "v"}, "at", after).collect()}
        want = {}
        for k, i, t in left:
            near = [(u, v) for h, u, v in right if h == k and (u >= t if after else u <= t)]
            want[i] = (min(near) if after else max(near)) if near else (None, None)
        assert got == want
    times = sorted({t for _, t, _ in right})
    got = {r.id: r.at for r in ordered.as_of(a, b.select("t").distinct(), [], "t", "t", {}, "at").collect()}
    assert got == {i: max((u for u in times if u <= t), default=None) for _, i, t in left}


def test_silences_by_dyadic_bins(spark, monkeypatch):
    """Many silences of all lengths and fields, and the plan: no pairs but by equal keys."""
    monkeypatch.setattr(alerts, "BROADCAST_SILENCES", -1)
    rng = random.Random(10)
    pick = lambda xs: rng.choice(xs)
    rows = [(i, pick("AB"), pick(["critical", "warning"]), pick(["s", "t"]), START + datetime.timedelta(seconds=rng.randrange(100_000))) for i in range(200)]
    quiet = []
    for i in range(150):
        begin = rng.randrange(100_000)
        end = begin + rng.choice([-5, 0, 1, 30, 3000, 50_000, 10**7])
        quiet.append((i, pick([None, "A", "B"]), pick([None, "critical"]), pick([None, None, "t"]), START + datetime.timedelta(seconds=begin), pick([START + datetime.timedelta(seconds=end)] * 9 + [None])))
    df = spark.createDataFrame(rows, "id int, alertname string, severity string, service string, starts_at timestamp")
    silences = spark.createDataFrame(quiet, "silence_id int, alertname string, severity string, service string, created_at timestamp, expires_at timestamp")
    found = alerts.apply_silences(df, silences)
    want = {}
    for i, *fields, t in rows:
        want[i] = min((s for s, *f, a, b in quiet if b and a <= t < b and all(x is None or x == y for x, y in zip(f, fields, strict=True))), default=None)
    assert {r.id: r.silenced_by for r in found.collect()} == want and 20 < sum(x is not None for x in want.values()) < 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_map_step_of_scalars_and_errors(spark):
    df = spark.createDataFrame([(1, [1, 2, 7]), (2, [])], "run_id int, items array<int>")
    got = dag.map_step(df, "run_id", "items", lambda x: x * 2, lambda x: x == 7, "continue", lambda x: F.concat(F.lit("no "), x.cast("string"))).collect()
    assert [(r.run_id, r.status, r.results, r.failed_items, [tuple(e) for e in r.item_errors]) for r in got] == [(1, "completed", [2, 4, None], [2], [(2, "no 7")])]
    one = dag.map_step(spark.createDataFrame([(1, 5)], "run_id int, items int"), "run_id", "items", lambda x: x + 1, lambda x: F.lit(False)).first()
    assert one.results == [6] and one.item_errors == []


def test_running_sums_in_pieces(spark):
    from opstables.operators import ranks

    rng = random.Random(3)
    rows = [("hot", rng.randrange(40), i, rng.choice([-1, 1])) for i in range(1500)] + [("cold", 1, 1, 5)]
    got = {(r.k, r.id): r.s for r in ranks.split_sum(spark.createDataFrame(rows, "k string, v int, id int, d bigint"), ["k"], "v", ["id"], "d", "s", 8).collect()}
    for key in ("hot", "cold"):
        total = 0
        for _, i, d in sorted((v, i, d) for k, v, i, d in rows if k == key):
            total += d
            assert got[key, i] == total


def test_tables_of_a_block_are_removed(spark):
    import os

    from opstables.sources import scratch

    with scratch.owned(spark) as made:
        kept, gone = scratch.stored(spark.range(3).toDF("x"), "t"), scratch.stored(spark.range(3).toDF("x"), "t")
        path = made.pop(0)
    assert kept.count() == 3 and os.path.exists(path) and gone.inputFiles() and not os.path.exists(gone.inputFiles()[0].removeprefix("file:"))


def test_branches_that_cannot_be_decided_are_taken(spark):
    rows = [(1, None, "abc", {"n": 5}, ["a"]), (2, 5, "", None, None), (3, 9, "x", {}, ["a", None])]
    df = spark.createDataFrame(rows, "id int, x int, s string, m map<string,int>, l array<string>")

    def taken(condition):
        return [r.taken for r in dag.branch(df, condition).orderBy("id").collect()]

    assert taken(lambda c: c.compare(c.name("x"), ">", 7)) == [True, False, True]
    assert taken(lambda c: c.negated(c.compare(c.name("x"), ">", 7))) == [True, True, False]  # the failure stays one
    assert taken(lambda c: c.compare(c.name("x"), "==", None)) == [True, False, False]
    assert taken(lambda c: c.compare(c.name("s"), ">", 3)) == [True] * 3 and taken(lambda c: c.compare(c.name("s"), "==", 3)) == [False] * 3
    assert taken(lambda c: c.compare(c.name("gone"), "!=", 1)) == [True] * 3 and taken(lambda c: c.name("gone")) == [False] * 3
    assert taken(lambda c: c.compare(c.name("m.n"), "==", 5)) == [True, True, False]
    assert taken(lambda c: c.compare(c.name("x.n"), "==", 5)) == [True] * 3 and taken(lambda c: c.compare(c.name("gone.n"), "==", 5)) == [True] * 3
    assert taken(lambda c: c.member(c.name("s"), ["abc", "x"])) == [True, False, True]
    assert taken(lambda c: c.member(None, c.name("l"))) == [False, False, True]
    assert taken(lambda c: c.member("a", c.name("l"), negated=True)) == [False, False, False]
    assert taken(lambda c: c.member("b", c.name("l"), negated=True)) == [True, False, True]
    assert taken(lambda c: c.member("b", c.name("s"))) == [True, False, False] and taken(lambda c: c.member("n", c.name("m"))) == [True, False, False]
    assert taken(lambda c: c.member(1, c.name("x"))) == [False] * 3 and taken(lambda c: c.member(1, c.name("s"), negated=True)) == [False] * 3
    assert taken(lambda c: c.every(c.compare(1, "==", 2), c.compare(c.name("x"), "<", 7))) == [True, False, False]  # null fails, whatever the rest
    assert taken(lambda c: c.some(c.name("s"), c.name("m"))) == [True, False, True]
    assert taken(lambda c: c.compare(True, "==", 1)) == [True] * 3


def test_tasks_missing_from_the_durable_table(spark):
    from opstables.operators import reconcile

    cache = spark.createDataFrame([("a-long-task-id", "t", "Cancelled", {"k": "v"}), ("b", None, "failed", {}), ("c", "t", "completed", None), ("d", "t", "running", None), (None, "t", "failed", None)], "task_id string, tenant_id string, status string, output map<string,string>")
    tasks = spark.createDataFrame([("c",), (None,)], "task_id string")
    got = {r.task_id: (r.tenant_id, r.status, r.output_data, r.tx_id) for r in reconcile.missing_durable(cache, tasks).collect()}
    assert got == {"a-long-task-id": ("t", "Cancelled", '{"k":"v"}', "reconciler-a-long-t"), "b": ("", "failed", None, "reconciler-b")}


def test_scan_limit_hides_ready_entries(spark):
    unit = queue.RANK_UNIT
    rows = [("c", i, "pending", unit + 10_000 + i) for i in range(3)] + [("c", 99, "pending", 2 * unit + 1)]
    entries = spark.createDataFrame(rows, "capability string, task_id bigint, queue_set string, score bigint")
    config = spark.createDataFrame([], "capability string, max_queue_depth int, max_concurrent int")
    assert queue.next_ready(entries, config, 5, scan_limit=3).count() == 0
    assert [r.task_id for r in queue.next_ready(entries, config, 5, scan_limit=None).collect()] == [99]


def test_notifications_wait_group_and_repeat(spark):
    data = [(i, "r", "warning", "s", "firing", START + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 10, 40, 1000])]
    df = spark.createDataFrame(data, "id bigint, alertname string, severity string, service string, status string, starts_at timestamp")
    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp())
    got = sorted((r.sent_at - base, r.n) for r in alerts.notifications(df).collect())
    assert got == [(30, 2), (330, 1), (1000, 1)]
    got = sorted((r.sent_at - base, r.n) for r in alerts.notifications(df, repeat=400).collect())
    assert got == [(30, 2), (330, 1), (730, 0), (1030, 1)]


def test_workers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id bigint, capability string")
    got = {r.id: (r.v, r.error) for r in udf.dispatch_by_capability(df, {"a": lambda p: p.assign(v=p["id"] * 10)}, "id bigint, v bigint").collect()}
    assert got[1] == (10, None) and "unknown capability b" in got[2][1] and "unknown" in got[3][1]
    with pytest.raises(ValueError):
        udf.assert_output(df, {"id": "bigint"}, allow_extra=False)
    assert udf.assert_output(df, {"id": "bigint"}) is df
    seen_df, seen = udf.observe_calls(df, {"known": F.col("capability") == "a"})
    seen_df.count()
    assert seen.get == {"calls": 3, "known": 1}


def test_json_sources(spark, tmp_path):
    raw = spark.createDataFrame([('{"n": "1"}',), ("",), ("[1]",), ("NOT_JSON{",), (None,), ("{bad",)], "raw string")
    assert [r.n for r in tables.parse_cache_snapshot(raw, "raw", "n string").collect()] == ["1"]
    (tmp_path / "dag.json").write_text('{"dag_id": "d", "steps": [{"step_name": "a"}, {"step_name": "b", "depends_on": ["a"]}]}')
    steps = tables.read_dag_steps(spark, str(tmp_path / "dag.json")).orderBy("idx").collect()
    assert [(r.step_name, r.depends_on) for r in steps] == [("a", None), ("b", ["a"])]
    (tmp_path / "log.txt").write_text('{"level": "INFO", "message": "m", "task_id": "7"}\nplain\n')
    logs = tables.read_logs(spark, str(tmp_path / "log.txt")).collect()
    assert [(r.level, r.extras) for r in logs] == [("INFO", {"task_id": "7"})]
