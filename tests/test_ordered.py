"""Scans, carried values and halos over cut keys against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from opstables.operators import alerts, fsm, metrics, ordered

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
#: Rows a piece and a block: whole keys, a piece of many blocks, many pieces of blocks.
CUTS = [(10**6, 1024), (10**6, 8), (90, 8)]


@pytest.fixture(params=CUTS)
def cut(request, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_A_PIECE", request.param[0])
    monkeypatch.setattr(ordered, "ROWS_A_BLOCK", request.param[1])
    return request.param


def times(rng, n, most_gap):
    """Rising seconds with ties and gaps."""
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 1, 2, 5, most_gap if rng.random() < 0.2 else 3])
        out.append(t)
    return out


def keyed(make, seed=1):
    """A key with nine tenths of the rows, small ones and a null."""
    rng = random.Random(seed)
    return [(k, i * 10 + j, t, make(rng)) for j, (k, n) in enumerate(((7, 900), (1, 40), (2, 1), (None, 60))) for i, t in enumerate(times(rng, n, 60))]


def frame(spark, rows, kind, time="ts", value="ok"):
    data = [(k, i, START + datetime.timedelta(seconds=t), v, 0) for k, i, t, v in rows]
    return spark.createDataFrame(data, f"entity bigint, id bigint, {time} timestamp, {value} {kind}, h int").repartition(5)


def folded(rows, start, step):
    """{(key, id): fields} of a step over each key's rows."""
    state, out = {}, {}
    for k, i, t, v in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        state[k], found = step(state.get(k, start), t + START.timestamp(), i, v)
        out |= {(k, r[0]): r[1:] for r in found}
    return out


def got(df, *fields):
    rows = df.collect()
    out = {(r.entity, r.id): tuple(r[f] for f in fields) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("bad", [0.2, 0.8])
def test_breakers(spark, cut, bad):
    rows = keyed(lambda rng: rng.choice([None, False]) if rng.random() < bad else True)
    df = frame(spark, rows, "boolean")
    assert got(fsm.breaker_timeline(df, "entity", 3, 20.0), "state", "failures") == folded(rows, fsm.BREAKER_START, fsm.breaker_step(3, 20.0))
    assert got(fsm.client_breaker_timeline(df, "entity", 3, 15.0), "allowed", "state") == folded(rows, fsm.CLIENT_BREAKER_START, fsm.client_breaker_step(3, 15.0))


def test_limiter(spark, cut):
    rows = keyed(lambda rng: True)
    step = fsm.limiter_step(20, 4)
    want = folded(rows, [], lambda s, t, i, v: step(s, int(t), i))
    assert got(fsm.rate_limit(frame(spark, rows, "boolean"), "entity", 20, 4), "allowed", "remaining", "retry_after", "reset") == want


def test_concurrency(spark, cut):
    rows = keyed(lambda rng: rng.choice([True, False, None]))
    step = lambda v, t, i, ok: (n := min(8, v + 1) if ok else max(1, v - 2), [(i, n)])
    df = fsm.concurrency_timeline(frame(spark, rows, "boolean"), "entity", 8, 2)
    assert got(df, "max_concurrent") == folded(rows, 8, step)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("table", "initial"), [(fsm.TASK_TABLE, "pending"), (fsm.NODE_TABLE, "idle")])
def test_machines(spark, cut, table, initial):
    names = [*{e for _, e in table}, "unknown", None]
    rows = keyed(lambda rng: rng.choice(names))
    df = fsm.replay_fsm(frame(spark, rows, "string", "created_at", "event"), "entity", table, initial)
    assert got(df, "event", "prev", "next", "legal") == folded(rows, initial, fsm.machine_step(table))


def test_scale_advice_of_cut_keys(spark, cut):
    rng = random.Random(5)
    rows = [(k, t, rng.choice([0.1, 0.5, 0.9, None])) for k, n in (("a", 700), ("b", 30)) for t in range(0, 5 * n, 5)]
    out = {(r.k, r.t): (r.advice, r.delta) for r in fsm.scale_advice(spark.createDataFrame(rows, "k string, t bigint, utilization double"), "k", cooldown=40).collect()}
    want, last = {}, {}
    for k, t, use in rows:
        if use is None:
            continue
        wants = 1 if use >= 0.8 else -1 if use <= 0.2 else 0
        acts = wants and t - last.get(k, -(10**9)) >= 40
        want[k, t] = (("up" if wants > 0 else "down"), wants) if acts else ("hold", 0)
        last[k] = t if acts else last.get(k, -(10**9))
    assert out == want


@pytest.mark.parametrize("reach", [1, 7, 100, 100_000])
def test_counters(spark, cut, reach):
    rng = random.Random(6)
    rows = [(k, t, float(rng.randrange(50))) for k, n in (("a", 600), ("b", 20), (None, 50)) for t in sorted(rng.sample(range(2000), n))]
    out = {(r.k, r.t): r.increase for r in metrics.counter_increase(spark.createDataFrame(rows, "k string, t bigint, value double"), ["k"], reach).collect()}
    want = {}
    for key in ("a", "b", None):
        own = [(t, v) for k, t, v in rows if k == key]
        inc = [0.0] + [v - u if v >= u else v for (_, u), (_, v) in zip(own, own[1:])]
        want |= {(key, t): sum(x for (s, _), x in zip(own, inc) if t - reach < s <= t) for t, _ in own}
    assert out == want


def test_windows_of_counters_are_running_sums(spark):
    """No frame slides: a window of 25,000 samples costs a sample no more than one of two."""
    samples = spark.range(50_000).selectExpr("'a' AS k", "id AS t", "CAST(id % 1000 AS DOUBLE) AS value")
    df = metrics.counter_increase(samples.union(spark.sql("SELECT 'b', CAST(NULL AS BIGINT), 1D UNION ALL SELECT 'b', 3L, 2D")), ["k"], 25_000)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$" in plan and "RangeFrame, -" not in plan
    # 999 of 1,000 samples grow by one, the first of a thousand falls to 0
    want = {t: (t + 1 - -(-(t + 1) // 1000)) - (max(0, t - 24_999) - -(-max(0, t - 24_999) // 1000)) for t in range(0, 50_000, 997)}
    assert {r.t: r.increase for r in df.where("k = 'a' AND t % 997 = 0").collect()} == want
    assert {(r.t, r.increase) for r in df.where("k = 'b'").collect()} == {(None, 0.0), (3, 1.0)}


def test_durations_and_rules(spark, cut):
    rng = random.Random(7)
    rows = [(k, t, rng.random() < 0.8) for k, n in (("a", 800), ("b", 20), (None, 50)) for t in range(n)]
    df = spark.createDataFrame(rows, "labels string, t bigint, on boolean")
    want = set()
    for key in ("a", "b", None):
        run = []
        for t, on in [(t, on) for k, t, on in rows if k == key] + [(None, False)]:
            if on:
                run.append(t)
            else:
                want |= {(key, run[0], run[-1])} if run and run[-1] - run[0] >= 3 else set()
                run = []
    assert {tuple(r) for r in alerts.for_duration(df, ["labels"], 3).collect()} == want
    samples = df.select(F.lit("m").alias("metric"), "labels", "t", F.when(F.col("on"), F.col("t")).otherwise(-1).cast("double").alias("value"))
    found = alerts.evaluate_rules(samples, [("High", "m", "value >= 0", 3, "warning"), ("Other", "n", "value > 0", 0, "info")])
    assert {(r.labels, r.starts_at, r.value) for r in found.collect()} == {(k, a, float(b)) for k, a, b in want}


def test_a_hot_label_is_many_tasks(spark, monkeypatch):
    """One label has all samples: no task windows more than a few pieces of it."""
    monkeypatch.setattr(ordered, "ROWS_A_PIECE", 20_000)
    samples = spark.range(300_000).selectExpr("concat('only', id DIV 10000000) AS labels", "id AS t", "CAST(id % 1000 AS DOUBLE) AS value")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        held = ordered.pieces(samples, ["labels"], "t")
        sizes = [r["count"] for r in held.rows.groupBy("_piece").count().collect()]
        assert len(sizes) == 15 and max(sizes) < 40_000
        df = metrics.counter_increase(samples, ["labels"], 300)
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.split("\n") if " Window " in line]
        assert len(windows) >= 2 and all("_piece" in line for line in windows)
        assert df.count() == 300_000 and df.where("increase NOT IN (299, 300)").count() == 299
        states = fsm.concurrency_timeline(samples.selectExpr("labels AS entity", "t AS id", "timestamp_seconds(t) AS ts", "t % 7 <> 0 AS ok"), "entity")
        assert states.groupBy("max_concurrent").count().count() == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "entity bigint, id bigint, ts timestamp, ok boolean")
    assert fsm.concurrency_timeline(empty, "entity").count() == 0
    assert fsm.client_breaker_timeline(empty, "entity").count() == 0
    assert metrics.counter_increase(spark.createDataFrame([], "k string, t bigint, value double"), ["k"], 5).count() == 0
