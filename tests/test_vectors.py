"""Label-set arithmetic, the threshold join of node picks, and routed notifications."""

import math

import pytest

from opstables.operators import queue
from opstables.operators import vectors as V


def _samples(spark, rows):
    return spark.createDataFrame(rows, "labels map<string,string>, t bigint, value double")


def _got(df):
    return sorted((tuple(sorted(r.labels.items())), r.t, r.value) for r in df.collect())


def test_match_ignoring_and_group_left(spark):
    rates = _samples(spark, [({"job": "a", "status": "bad"}, 1, 1.0), ({"job": "a", "status": "slow"}, 1, 2.0), ({"job": "b", "status": "bad", "x": ""}, 1, 5.0), ({"job": "c", "status": "bad"}, 1, 5.0)])
    sums = _samples(spark, [({"job": "a", "team": "t"}, 1, 10.0), ({"job": "b", "x": None}, 1, 0.0), ({"job": "c"}, 2, 1.0), (None, 1, 1.0)])
    by_job = V.match(rates, sums, "/", on=("job",), group="left", include=("team",))
    assert _got(by_job) == [((("job", "a"), ("status", "bad"), ("team", "t")), 1, 0.1), ((("job", "a"), ("status", "slow"), ("team", "t")), 1, 0.2), ((("job", "b"), ("status", "bad")), 1, math.inf)]
    turned = V.match(sums, rates, ">", on=("job",), group="right")
    assert _got(turned) == [((("job", "a"), ("status", "bad")), 1, 10.0), ((("job", "a"), ("status", "slow")), 1, 10.0)]
    one = V.match(V.total(rates, without=("status", "x")), sums, "-", ignoring=("team",))
    assert _got(one) == [((("job", "a"),), 1, -7.0), ((("job", "b"),), 1, 5.0)]


def test_several_series_on_the_one_side_fail(spark):
    rates = _samples(spark, [({"job": "a", "status": "bad"}, 1, 1.0), ({"job": "a", "status": "good"}, 1, 2.0)])
    bad = rates.where("labels['status'] = 'bad'")
    with pytest.raises(Exception, match="several series on the right side"):
        V.match(bad, rates, "/", ignoring=("status",), group="left").collect()
    with pytest.raises(Exception, match="several series on the left side"):
        V.match(rates, bad, "/", ignoring=("status",)).collect()
    assert _got(V.match(rates, bad, "/", ignoring=("status",), group="left")) == [((("job", "a"), ("status", "bad")), 1, 1.0), ((("job", "a"), ("status", "good")), 1, 2.0)]
    with pytest.raises(ValueError):
        V.match(rates, bad, "/", on=("job",), ignoring=("status",))


def test_values_that_are_no_numbers(spark):
    nan, inf = math.nan, math.inf
    pairs = [(0.0, 0.0), (-1.0, 0.0), (nan, 0.0), (1.0, nan), (None, 2.0), (3.0, 2.0)]
    left = _samples(spark, [({"i": str(i)}, 0, a) for i, (a, _) in enumerate(pairs)])
    right = _samples(spark, [({"i": str(i)}, 0, b) for i, (_, b) in enumerate(pairs)])

    def values(op):
        return {int(r.labels["i"]): r.value for r in V.match(left, right, op).collect()}

    got = values("/")
    assert math.isnan(got[0]) and got[1] == -inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] is None and got[5] == 1.5
    assert set(values(">")) == {5} and set(values("!=")) == {1, 2, 3, 5} and set(values("<")) == {1} and set(values("==")) == {0}
    got = values("%")
    assert math.isnan(got[0]) and got[5] == 1.0
    assert values("^")[5] == 9.0 and values("+")[5] == 5.0 and values("*")[1] == 0
    assert V.match(left, right.limit(0), "+").count() == 0 and V.compare(left, ">", 1).count() == 1


def test_requests_take_nodes_up_to_their_cut(spark):
    nodes = spark.createDataFrame([(1, "idle", 4), (2, "idle", 8), (3, "busy", 8), (4, "idle", 4), (5, "idle", 0), (6, None, 2), (7, "idle", None)], "node_id bigint, state string, gpus int")
    asked = spark.createDataFrame([(1, 8.0), (2, 8.5), (3, 16.0), (4, 99.0), (5, 0.0), (6, None), (7, -1.0), (8, 8.0)], "request_id bigint, required_gpus double")
    got = {r.request_id: (r.n_nodes, r.taken_gpus, r.met) for r in queue.node_cuts(asked, nodes).collect()}
    assert got == {1: (1, 8, True), 2: (2, 12, True), 3: (3, 16, True), 4: (3, 16, False), 5: (0, 0, True), 6: (0, 0, False), 7: (0, 0, True), 8: (1, 8, True)}
    pairs = sorted((r.request_id, r.node_id, r.running_gpus) for r in queue.greedy_nodes(asked, nodes).collect())
    assert pairs == [(1, 2, 0), (2, 1, 8), (2, 2, 0), (3, 1, 8), (3, 2, 0), (3, 4, 12), (4, 1, 8), (4, 2, 0), (4, 4, 12), (8, 2, 0)]
    assert queue.node_cuts(asked, nodes.limit(0)).where("n_nodes > 0").count() == 0 and queue.node_cuts(asked.limit(0), nodes).count() == 0


def test_node_cuts_pair_nothing(spark, monkeypatch):
    from opstables.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_A_PIECE", 50)
    nodes = spark.range(200).selectExpr("id AS node_id", "'idle' AS state", "CAST(1 + id % 7 AS INT) AS gpus")
    asked = spark.range(900).selectExpr("id AS request_id", "CAST(id AS DOUBLE) AS required_gpus")
    df = queue.node_cuts(asked, nodes)
    sizes = sorted((1 + i % 7 for i in range(200)), reverse=True)
    starts = [sum(sizes[:i]) for i in range(200)]
    assert {r.request_id: r.n_nodes for r in df.collect()} == {i: sum(s < i for s in starts) for i in range(900)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_routing_rules_as_a_table(spark):
    from opstables.operators import alerts

    rows = spark.createDataFrame([(1, "A", "critical", "s", {"team": "x"}), (2, "A", "info", None, {"service": "s"}), (3, None, None, "t", None)], "id bigint, alertname string, severity string, service string, extra map<string,string>")
    rules = [(1, {"alertname": "A", "service": "s"}, "pager"), (2, {"team": "x"}, "mail"), (3, {}, "log"), (4, None, "never"), (5, {"service": None}, "never"), (6, {"alertname": "A", "team": "y"}, "never"), (7, {"severity": "critical"}, "chat"), (8, {"service": "s"}, "log")]
    got = {r.id: r.channels for r in alerts.route_by_rules(rows, spark.createDataFrame(rules, "rule_id bigint, match map<string,string>, channel string")).collect()}
    assert got == {1: ["chat", "webhook", "log", "mail", "pager"], 2: ["webhook", "log", "pager"], 3: ["webhook", "log"]}
