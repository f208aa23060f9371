"""DuckDB SQL of the folds: a recursion that takes each key's rows one by one, in order."""

from __future__ import annotations

from opstables.operators import fsm


def fold_sql(rows: str, key: str, state: dict[str, str], layers: list[dict[str, str]], out: str, order: str = "t, id") -> str:
    """rows: SQL of the rows; state: names -> first values; layers: names -> expressions, each over the row, the state before it (name_) and the layers before.

    The last layer gives the state's names; out is selected from the rows with their states.
    """
    names = ", ".join(state)
    inner = f"SELECT e.*, {', '.join(f'r.{n} AS {n}_' for n in state)} FROM r JOIN e ON e.{key} = r.{key} AND e.rn = r.rn + 1"
    for layer in layers[:-1]:
        inner = f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in layer.items())} FROM ({inner})"
    last = ", ".join(layers[-1][n] for n in state)
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({rows})),
  r({key}, rn, {names}) AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT), {", ".join(state.values())} FROM e UNION ALL SELECT {key}, rn, {last} FROM ({inner})),
  s AS (SELECT e.*, {', '.join(f'r.{n} AS {n}' for n in state)}, {', '.join(f'b.{n} AS {n}_' for n in state)} FROM r JOIN e USING ({key}, rn) JOIN r b ON b.{key} = r.{key} AND b.rn = r.rn - 1)
  {out}"""


_CHECKS = "SELECT entity, id, ok, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS t FROM health_checks"


def breaker(threshold: int, open_s: int, columns: str = "entity, id, state, n AS failures") -> str:
    return fold_sql(
        _CHECKS, "entity", {"n": "0", "latest": "CAST(-1 AS DOUBLE)", "until": "CAST(-1 AS DOUBLE)", "state": "''"},
        [
            {"is_open": "t < until_", "n0": f"CASE WHEN t - latest_ >= {4 * open_s} THEN 0 ELSE n_ END"},
            {"n1": "CASE WHEN ok THEN 0 WHEN is_open THEN n0 ELSE n0 + 1 END"},
            {"trips": f"NOT is_open AND NOT ok AND n1 >= {threshold}"},
            {
                "n": "CASE WHEN trips THEN 0 ELSE n1 END", "latest": "CASE WHEN ok OR is_open THEN latest_ ELSE t END", "until": f"CASE WHEN trips THEN t + {open_s} ELSE until_ END",
                "state": "CASE WHEN trips OR is_open THEN 'open' ELSE 'closed' END",
            },
        ],
        f"SELECT {columns} FROM s",
    )


def client_breaker(threshold: int, reset_s: int) -> str:
    return fold_sql(
        _CHECKS, "entity", {"n": "0", "latest": "CAST(-1 AS DOUBLE)", "state": "'closed'", "allowed": "true"},
        [
            {"half": f"state_ = 'half_open' OR (state_ = 'open' AND t - latest_ > {reset_s})"},
            {"goes": "state_ = 'closed' OR half"},
            {"n1": "CASE WHEN NOT goes THEN n_ WHEN ok THEN 0 ELSE n_ + 1 END"},
            {
                "n": "n1", "latest": "CASE WHEN goes AND NOT ok THEN t ELSE latest_ END", "allowed": "goes",
                "state": f"CASE WHEN NOT goes THEN 'open' WHEN ok THEN 'closed' WHEN n1 >= {threshold} THEN 'open' WHEN half THEN 'half_open' ELSE 'closed' END",
            },
        ],
        "SELECT entity, id, allowed, state FROM s",
    )


def limiter(window: int, most: int, columns: str = "entity, id, allowed, CASE WHEN allowed THEN {most} - n - 1 ELSE 0 END AS remaining, retry AS retry_after, t + CASE WHEN allowed THEN {window} ELSE retry END AS reset") -> str:
    return fold_sql(
        "SELECT entity, id, epoch_us(ts) // 1000000 AS t FROM health_checks", "entity", {"held": "CAST([] AS BIGINT[])", "n": "CAST(0 AS BIGINT)", "allowed": "true", "retry": "CAST(0 AS BIGINT)"},
        [
            {"live": f"list_filter(held_, lambda x: x > t - {window})"},
            {"k": "len(live)"},
            {
                "held": f"CASE WHEN k < {most} AND NOT list_contains(live, t) THEN list_append(live, t) ELSE live END", "n": "k", "allowed": f"k < {most}",
                "retry": f"CASE WHEN k < {most} THEN 0 ELSE greatest(1, list_min(live) + {window} - t) END",
            },
        ],
        f"SELECT {columns.format(most=most, window=window)} FROM s",
    )


def concurrency(baseline: int = 8, down: int = 1) -> str:
    return fold_sql(_CHECKS, "entity", {"v": str(baseline)}, [{"v": f"CASE WHEN ok THEN least({baseline}, v_ + 1) ELSE greatest(1, v_ - {down}) END"}], "SELECT entity, id, v AS max_concurrent FROM s")


def machine(table: dict[tuple[str, str], str], initial: str, event: str = "event", columns: str = "task_id, id, event, state_ AS prev, state AS next, hit IS NOT NULL AS legal") -> str:
    cases = " ".join(f"WHEN '{a}|{b}' THEN '{c}'" for (a, b), c in table.items())
    return fold_sql(
        f"SELECT task_id, id, {event} AS event, epoch_us(created_at) AS t FROM task_events", "task_id", {"state": f"'{initial}'", "hit": "CAST(NULL AS VARCHAR)"},
        [{"to_": f"CASE state_ || '|' || event {cases} END"}, {"state": "coalesce(to_, state_)", "hit": "to_"}], f"SELECT {columns} FROM s",
    )


def scale(cooldown: int, up: float = 0.8, down: float = 0.2) -> str:
    return fold_sql(
        "SELECT capability, epoch_us(ts) // 3600000000 * 3600 AS t, avg(duration_seconds) / 100 AS use FROM health_checks GROUP BY 1, 2", "capability", {"latest": "CAST(-1000000000 AS BIGINT)", "delta": "0"},
        [
            {"wants": f"CASE WHEN use >= {up} THEN 1 WHEN use <= {down} THEN -1 ELSE 0 END"},
            {"acts": f"wants <> 0 AND t - latest_ >= {cooldown}"},
            {"latest": "CASE WHEN acts THEN t ELSE latest_ END", "delta": "CASE WHEN acts THEN wants ELSE 0 END"},
        ],
        "SELECT capability, t, CASE delta WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'hold' END AS advice, delta FROM s", order="t",
    )


def notifications(wait: int = 30, interval: int = 300, repeat: int = 43200) -> str:
    big = "CAST(NULL AS BIGINT)"
    return fold_sql(
        "SELECT concat_ws('|', alertname, severity, service) AS g, alertname, severity, service, id, epoch_us(starts_at) // 1000000 AS t FROM alerts WHERE status = 'firing'",
        "g", {"due": big, "sent": big, "n": "CAST(0 AS BIGINT)", "told": "CAST(0 AS BIGINT)", "since": big},
        [
            {"flush": "coalesce(t > due_, false)"},
            {"before": "CASE WHEN flush THEN due_ ELSE sent_ END"},
            {"k": f"CASE WHEN flush THEN (t - before - 1) // {repeat} ELSE 0 END"},
            {
                "due": f"CASE WHEN due_ IS NULL THEN t + {wait} WHEN flush THEN greatest(t, before + k * {repeat} + {interval}) ELSE due_ END",
                "sent": f"before + k * {repeat}", "n": "CASE WHEN flush THEN 1 ELSE n_ + 1 END", "told": "k", "since": "before",
            },
        ],
        f"""SELECT alertname, severity, service, due_ AS sent_at, n_ AS n FROM s WHERE t > due_
  UNION ALL SELECT alertname, severity, service, since + i * {repeat}, 0 FROM (SELECT *, unnest(range(1, told + 1)) AS i FROM s)
  UNION ALL SELECT alertname, severity, service, due, n FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY rn DESC) = 1""",
    )


def routed_notifications(tree: list[tuple]) -> str:
    """tree: (place, severity, alertname, receiver, wait, interval, repeat), null for any."""
    def text(v: object) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    rows = ", ".join(f"({', '.join(map(text, r))})" for r in tree)
    group = "alertname, severity, service"
    turns = f"""SELECT {group}, epoch_us(starts_at) // 1000000 AS t, CASE WHEN is_on THEN 1 ELSE -1 END AS step FROM (SELECT *, status = 'firing' AS is_on,
      coalesce(lag(status = 'firing') OVER (PARTITION BY {group}, fingerprint ORDER BY starts_at, id), false) AS was FROM alerts WHERE status IN ('firing', 'resolved')) WHERE is_on <> was"""
    seconds = f"SELECT {group}, t, sum(step) AS step, count(*) FILTER (step = 1) AS fresh FROM ({turns}) GROUP BY ALL"
    counted = f"SELECT *, sum(step) OVER (PARTITION BY {group} ORDER BY t) AS active FROM ({seconds})"
    lived = f"SELECT * FROM (SELECT *, sum(CASE WHEN active > 0 AND active = step THEN 1 ELSE 0 END) OVER (PARTITION BY {group} ORDER BY t) AS span FROM ({counted})) WHERE active > 0 OR step < 0"
    spans = f"SELECT {group}, span, min(t) AS t, max(t) FILTER (active = 0) AS fin FROM ({lived}) GROUP BY ALL"
    routed = f"""SELECT concat_ws('|', {', '.join(f's.{c}' for c in group.split(', '))}) AS g, s.*, span AS id, x.* EXCLUDE (severity, alertname) FROM ({spans}) s
      JOIN (VALUES {rows}) x(place, severity, alertname, receiver, wait, every, again) ON (x.severity IS NULL OR x.severity = s.severity) AND (x.alertname IS NULL OR x.alertname = s.alertname)
      QUALIFY row_number() OVER (PARTITION BY s.alertname, s.severity, s.service, span ORDER BY place) = 1"""
    none = "CAST(NULL AS BIGINT)"

    def look(t: str, opened: str, of: str = "") -> str:
        return f"({opened} + {of}wait + CAST(greatest(ceil(({t} - {opened} - {of}wait) / {of}every), 0) AS BIGINT) * {of}every)"

    return fold_sql(
        routed, "g", {"opened": none, "ended": none},
        [{"seen": look("ended_", "opened_")}, {"opened": "CASE WHEN opened_ IS NULL OR t > seen THEN t ELSE opened_ END", "ended": "fin"}],
        f""", lived AS ({lived}),
  lives AS (SELECT g, {group}, opened, receiver, wait, every, again, CASE WHEN bool_and(fin IS NOT NULL) THEN max(fin) END AS fin FROM s GROUP BY ALL),
  closed AS (SELECT *, CASE WHEN fin IS NOT NULL THEN {look('fin', 'opened')} END AS close FROM lives),
  kept AS (SELECT * FROM closed WHERE close IS NULL OR close > opened + wait),
  told AS (SELECT k.*, {look('l.t', 'k.opened', 'k.')} AS sent, sum(l.fresh) AS n FROM kept k JOIN s ON s.g = k.g AND s.opened = k.opened JOIN lived l ON l.alertname = s.alertname AND l.severity = s.severity AND l.service = s.service AND l.span = s.span
           WHERE l.fresh > 0 GROUP BY ALL),
  nexts AS (SELECT *, coalesce(lead(sent) OVER (PARTITION BY g, opened ORDER BY sent), close, (SELECT max(t) FROM lived) + 1) AS following, CAST(ceil(again / every) AS BIGINT) * every AS pace FROM told WHERE close IS NULL OR sent < close)
  SELECT {group}, receiver, sent AS sent_at, 'firing' AS kind, n FROM nexts
  UNION ALL SELECT {group}, receiver, sent + i * pace, 'repeat', 0 FROM (SELECT *, unnest(range(1, 1 + greatest((following - sent - 1) // pace, 0))) AS i FROM nexts)
  UNION ALL SELECT {group}, receiver, close, 'resolved', 0 FROM kept WHERE close IS NOT NULL""",
    )


def lifecycle(for_s: int) -> str:
    return fold_sql(
        'SELECT CAST(user_id AS VARCHAR) AS labels, event_id AS id, value > 30 AS "on", CAST(epoch_us(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1000000 AS t FROM events', "labels",
        {"state": "'inactive'", "since": "CAST(NULL AS DOUBLE)"},
        [
            {"began": "CASE WHEN state_ = 'inactive' THEN t ELSE since_ END"},
            {"state": f"""CASE WHEN NOT "on" THEN 'inactive' WHEN state_ = 'firing' OR t - began >= {for_s} THEN 'firing' ELSE 'pending' END""", "since": 'CASE WHEN "on" THEN began END'},
        ],
        """SELECT labels, t AS at, 'resolved' AS state FROM s WHERE state_ = 'firing' AND state = 'inactive' UNION ALL SELECT labels, t, 'pending' FROM s WHERE state_ = 'inactive' AND state <> 'inactive'
  UNION ALL SELECT labels, t, 'firing' FROM s WHERE state = 'firing' AND state_ <> 'firing'""",
    )


def alert_changes(rules: list[tuple[str, str, int, str]], length: int) -> str:
    """Windows of length seconds that the last event has passed, by rules, through the alert machine."""
    us = length * 1_000_000
    windows = f"""SELECT * FROM (SELECT concat('cap-', CAST(user_id % 8 AS VARCHAR)) AS capability, (epoch_us(CAST(ts AS TIMESTAMP)) // {us} + 1) * {length} AS t, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, avg(value) AS mean
      FROM events GROUP BY 1, 2) WHERE t * 1000 <= (SELECT max(epoch_us(CAST(ts AS TIMESTAMP))) // 1000 FROM events)"""
    evals = " UNION ALL ".join(f"""SELECT capability || '|{a}' AS g, capability, '{a}' AS alertname, '{s}' AS severity, {d} AS hold, t, t AS id, {p} AS "on" FROM ({windows})""" for a, p, d, s in rules)
    return fold_sql(
        evals, "g", {"state": "'inactive'", "since": "CAST(NULL AS BIGINT)"},
        [
            {"began": "CASE WHEN state_ = 'inactive' THEN t ELSE since_ END"},
            {"state": """CASE WHEN NOT "on" THEN 'inactive' WHEN state_ = 'firing' OR t - began >= hold THEN 'firing' ELSE 'pending' END""", "since": 'CASE WHEN "on" THEN began END'},
        ],
        """SELECT alertname, severity, capability, t AS at, 'resolved' AS state FROM s WHERE state_ = 'firing' AND state = 'inactive' UNION ALL SELECT alertname, severity, capability, t, 'pending' FROM s WHERE state_ = 'inactive' AND state <> 'inactive'
  UNION ALL SELECT alertname, severity, capability, t, 'firing' FROM s WHERE state = 'firing' AND state_ <> 'firing'""",
    )


NODE_EVENT = "CASE event WHEN 'enqueue' THEN 'reserve' WHEN 'start' THEN 'join' WHEN 'complete' THEN 'drain' WHEN 'fail' THEN 'offline' ELSE 'release' END"
TASKS, NODES = (fsm.TASK_TABLE, "pending"), (fsm.NODE_TABLE, "idle", NODE_EVENT)
#: What the streams of the same machines show.
SHOWN = "task_id, id, state_ AS prev, state AS next, hit IS NOT NULL AS legal"
