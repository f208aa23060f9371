"""Routed notifications against a clock that looks at each group as its ticks come."""

import datetime
import random

import pytest

from opstables.operators import alerts, ordered

T0 = datetime.datetime(2024, 1, 1)
BASE = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp())
SCHEMA = "id bigint, alertname string, severity string, service string, fingerprint string, status string, starts_at timestamp"
TREE = "place int, severity string, alertname string, receiver string, wait_s bigint, interval_s bigint, repeat_s bigint"
ROUTES = [(0, "critical", "down", "pager", 3, 10, 15), (1, "critical", None, "ops", 25, 10, 30), (2, None, "down", "mail", 7, 20, 20), (3, None, None, "hook", 12, 30, 70)]


def _route(severity, name):
    return next(r for r in ROUTES if r[1] in (None, severity) and r[2] in (None, name))


def _clock(rows, as_of):
    """A group at a time, a second at a time."""
    out = []
    for g in sorted({r[1:4] for r in rows}):
        _, _, _, to, wait, interval, repeat = _route(g[1], g[0])
        mine = sorted((r[6], r[0], r[4], r[5]) for r in rows if r[1:4] == g)
        firing, opened, fresh, told = set(), None, 0, None
        for t in range(as_of + 2000):
            before, earlier = bool(firing), fresh
            for _, _, f, status in [x for x in mine if x[0] == t]:
                if status == "firing" and f not in firing:
                    firing.add(f)
                    fresh += 1
                elif status == "resolved":
                    firing.discard(f)
            if not before and not firing:  # what came and went within a second of quiet
                fresh = earlier
            if opened is None and firing:
                opened, told = t, None
            if opened is None or t < opened + wait or (t - opened - wait) % interval:
                continue
            if not firing:
                if told is not None:
                    out.append((*g, to, t, "resolved", 0))
                opened, fresh = None, 0
            elif fresh:
                out.append((*g, to, t, "firing", fresh))
                told, fresh = t, 0
            elif t - told >= repeat and t <= as_of:
                out.append((*g, to, t, "repeat", 0))
                told = t
    return sorted(out)


@pytest.mark.parametrize("piece", [10**6, 20])
def test_routed_notifications_equal_the_clock(spark, monkeypatch, piece):
    monkeypatch.setattr(ordered, "ROWS_A_PIECE", piece)
    rng = random.Random(piece)
    rows = []
    for name, severity in (("down", "critical"), ("slow", "critical"), ("down", "info"), ("slow", "info")):
        t = 0
        for _ in range(200):
            t += rng.choice((0, 0, 1, 1, 2, 5, 9, 20, 60, 150))
            rows.append((len(rows), name, severity, rng.choice("ab"), rng.choice("xy"), rng.choice(("firing", "resolved", "resolved")), t))
    stamped = [(*r[:6], T0 + datetime.timedelta(seconds=r[6])) for r in rows]
    as_of = max(r[6] for r in rows)
    df = spark.createDataFrame(stamped, SCHEMA)
    found = alerts.routed_notifications(df, spark.createDataFrame(ROUTES, TREE), BASE + as_of).collect()
    got = sorted((r.alertname, r.severity, r.service, r.receiver, r.sent_at - BASE, r.kind, r.n) for r in found)
    assert got == _clock(rows, as_of)
    assert {r.kind for r in found} == {"firing", "repeat", "resolved"}


def test_a_group_is_silent_after_its_resolve(spark):
    def at(s):
        return T0 + datetime.timedelta(seconds=s)

    rows = [(1, "ServiceDown", "critical", "s", "f", "firing", at(0)), (2, "ServiceDown", "critical", "s", "f", "firing", at(5)), (3, "ServiceDown", "critical", "s", "f", "resolved", at(700)), (4, "Other", None, None, None, "firing", at(0)), (5, "Other", None, None, None, "resolved", at(3)), (6, "Odd", "info", "s", "f", "firing", None)]
    found = alerts.routed_notifications(spark.createDataFrame(rows, SCHEMA), alerts.routes(spark), BASE + 10**6)
    assert sorted((r.receiver, r.sent_at - BASE, r.kind, r.n) for r in found.collect()) == [("critical-ops", 10, "firing", 1), ("critical-ops", 310, "repeat", 0), ("critical-ops", 610, "repeat", 0), ("critical-ops", 910, "resolved", 0)]
    assert alerts.routed_notifications(spark.createDataFrame([], SCHEMA), alerts.routes(spark)).count() == 0
