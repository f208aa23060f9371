"""Alert lists, routing, silencing, inhibition, durations and notifications."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opstables.operators.ordered import pieces
from opstables.operators.ranks import if_small
from opstables.operators.runs import fold_sorted
from opstables.sources.scratch import stored

#: Channels by severity, where route_alerts is given none.
CHANNELS = {"critical": ("chat", "webhook"), "warning": ("chat",), "info": ("webhook",)}
#: Receivers by (severity, alert) in order, with seconds between repeats.
RECEIVERS = (
    ("critical", "ServiceDown", "critical-ops", 300),
    ("critical", "RedisCircuitBreakerOpen", "critical-ops", 300),
    ("critical", None, "critical-ops", 600),
    ("warning", None, "warning-ops", 1800),
    ("info", None, "default-webhook", 21600),
)
DEFAULT_RECEIVER, DEFAULT_REPEAT = "default-webhook", 43200
#: Seconds that a new group of the routes above waits, in their order; of all others; between later notifications.
ROUTE_WAITS = (10, 10, 15, 30, 30)
DEFAULT_WAIT, GROUP_INTERVAL = 30, 300
#: The most silences that are broadcast.
BROADCAST_SILENCES = 10_000


#: The catalogue of threshold rules: alert, metric, comparison, threshold, seconds it must hold, severity.
CATALOGUE = (
    ("ServiceDown", "service_up", "=", 0, 60, "critical"),
    ("HighHttpErrorRate", "http_error_ratio", ">", 0.01, 300, "warning"),
    ("HighP99Latency", "http_p99", ">", 2.0, 300, "warning"),
    ("QueueBacklogHigh", "queue_depth", ">", 100, 300, "warning"),
    ("QueueBacklogCritical", "queue_depth", ">", 500, 120, "critical"),
    ("QueueStalled", "stalled_depth", ">", 10, 600, "critical"),
    ("HighTaskFailureRate", "task_failure_ratio", ">", 0.05, 300, "critical"),
    ("SlowTaskExecution", "task_p95", ">", 30, 300, "warning"),
    ("TaskExecutionTimeout", "task_p95", ">", 120, 120, "critical"),
    ("RedisConnectionLost", "store_up", "=", 0, 60, "critical"),
    ("RedisCircuitBreakerOpen", "store_breaker_state", "=", 2, 30, "critical"),
    ("RedisDegradationModeActive", "store_degraded", "=", 1, 120, "warning"),
    ("RedisDegradationQueueLarge", "store_degraded_queue", ">", 100, 300, "warning"),
    ("RedisHighLatency", "store_p95", ">", 0.1, 300, "warning"),
    ("DBConnectionPoolExhausted", "db_idle", "=", 0, 120, "critical"),
    ("DBSlowQueries", "db_p95", ">", 1.0, 300, "warning"),
    ("HighMemoryUsage", "memory_mb", ">", 512, 300, "warning"),
    ("CriticalMemoryUsage", "memory_mb", ">", 1024, 120, "critical"),
)


def list_alerts(alerts: DataFrame, limit: int, status: str | None = None, severity: str | None = None, service: str | None = None, filter_first: bool = False) -> DataFrame:
    """The newest alerts; the limit comes before the filters unless filter_first."""
    def newest(df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("starts_at").desc(), F.col("id").desc()).limit(limit)

    out = alerts if filter_first else newest(alerts)
    for c, v in (("status", status), ("severity", severity), ("service", service)):
        if v is not None:
            out = out.where(F.col(c) == v)
    return newest(out) if filter_first else out


def route_alerts(alerts: DataFrame, rules: tuple[tuple[dict[str, str], str], ...] = (), channels: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Channels of each alert: the severity's, then those of matching rules (labels -> channel), each once.

    A rule's label is a column or, where there is none or it is null, an entry of the map `extra` (if alerts has one).
    """
    base = F.lit(None)
    for severity, own in (CHANNELS if channels is None else channels).items():
        base = F.when(F.col("severity") == severity, F.array(*map(F.lit, own))).otherwise(base)
    own = F.coalesce(base, F.array(F.lit("webhook")))

    def label(name: str) -> Column:
        found = [F.col(name).cast("string")] if name in alerts.columns else []
        return F.coalesce(*found, *([F.try_element_at("extra", F.lit(name))] if "extra" in alerts.columns else []), F.lit(None))

    matched = []
    for match, channel in rules:
        hit = F.lit(True)
        for c, v in match.items():
            hit = hit & (label(c) == v)
        matched.append(F.when(hit, F.lit(channel)))
    extra = F.array_compact(F.array(*matched)) if matched else F.array().cast("array<string>")
    return alerts.withColumn("channels", F.array_distinct(F.concat(own, extra)))


def route_by_rules(alerts: DataFrame, rules: DataFrame, labels: tuple[str, ...] = ("alertname", "severity", "service", "fingerprint")) -> DataFrame:
    """P16 with rules as a table (rule_id, match map<string,string>, channel): alerts with channels, the severity's first, then those of matching rules by name, each once.

    A rule is found by the one of its labels that the fewest rules name, then tested on the others; an empty match fits all alerts, a null match
    or value none.  A label is a column or, where that is null, an entry of the map `extra` (if alerts has one).
    """
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in labels if c in alerts.columns)), lambda e: e["value"].isNotNull())
    own = F.map_from_entries(pairs)
    if "extra" in alerts.columns:
        more = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
        own = F.map_concat(own, F.map_filter(more, lambda k, v: ~F.array_contains(F.map_keys(own), k)))
    named = rules.select("rule_id", "match", "channel", F.explode(F.map_entries("match")).alias("_e")).select("rule_id", F.map_entries("match").alias("_match"), "channel", "_e")
    uses = named.groupBy("_e").agg(F.count("*").alias("_uses"))
    anchors = named.join(uses, "_e").groupBy("rule_id", "_match", "channel").agg(F.min_by("_e", F.struct("_uses", "_e")).alias("_e")).drop("rule_id")
    looks = alerts.select("id", own.alias("_own")).select("id", "_own", F.explode(F.map_entries("_own")).alias("_e"))
    fits = F.forall("_match", lambda e: F.coalesce(F.try_element_at("_own", e["key"]) == e["value"], F.lit(False)))
    found = looks.join(if_small(anchors), "_e").where(fits).groupBy("id").agg(F.collect_set("channel").alias("_found"))
    always = rules.where(F.size("match") == 0).agg(F.collect_set("channel").alias("_always"))  # one row
    rows = route_alerts(alerts, ()).join(found, "id", "left").crossJoin(F.broadcast(always))
    extra = F.array_sort(F.array_union(F.coalesce("_found", F.array().cast("array<string>")), F.col("_always")))
    return rows.withColumn("channels", F.array_union("channels", extra)).drop("_found", "_always")


def route_receiver(alerts: DataFrame) -> DataFrame:
    """The first receiver of the tree that matches, and how often it hears again."""
    receiver, repeat = None, None
    for severity, name, to, seconds in RECEIVERS:
        hit = (F.col("severity") == severity) & (F.lit(True) if name is None else F.col("alertname") == name)
        receiver = F.when(hit, to) if receiver is None else receiver.when(hit, to)
        repeat = F.when(hit, seconds) if repeat is None else repeat.when(hit, seconds)
    return alerts.withColumns({"receiver": receiver.otherwise(DEFAULT_RECEIVER), "repeat_seconds": repeat.otherwise(DEFAULT_REPEAT)})


def render_alert(alerts: DataFrame, channel: str) -> DataFrame:
    """(id, subject, body) of a mail, (id, message) for a chat, or (id, payload) for a webhook: JSON of all columns.

    Texts name what alerts has of service, starts_at, summary, description, runbook_url and, in mails, all labels.
    """
    def has(name: str, title: str, shown: Column | None = None) -> list[Column]:
        value = F.coalesce((F.col(name) if shown is None else shown).cast("string"), F.lit("-"))
        return [F.concat(F.lit(f"{title}: "), value)] if name in alerts.columns else []

    when = F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss")
    facts = [*has("service", "service"), *has("starts_at", "since", when), *has("summary", "summary"), *has("description", "details"), *has("runbook_url", "runbook")]
    if channel == "webhook":
        return alerts.select("id", F.to_json(F.struct(*(c for c in alerts.columns if c != "id"))).alias("payload"))
    if channel == "chat":
        return alerts.select("id", F.concat_ws("\n", F.concat_ws(" ", F.col("status"), F.col("severity"), F.col("alertname")), *facts).alias("message"))
    labels = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit("-"))) for c in ("alertname", "severity", "service", "fingerprint") if c in alerts.columns))
    subject = F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.upper("severity"), F.lit(": "), F.col("alertname"))
    return alerts.select("id", subject.alias("subject"), F.concat_ws("\n", *has("status", "status"), *has("severity", "severity"), *facts, F.concat(F.lit("labels: "), labels)).alias("body"))


def apply_silences(alerts: DataFrame, silences: DataFrame) -> DataFrame:
    """C11: the first silence (a null field matches anything, from created_at up to expires_at) that covers each alert.

    Few silences are broadcast; more are found by an index of intervals: a silence stands in the one or two bins, of the least power of
    two that its length fits in, that it touches; an alert looks in the bin of its time for each of these sizes (at most 63),
    together with the fields that the silences set.  So every pair that is tried has its keys in common, and most match.
    """
    fields = ("alertname", "severity", "service")
    s = silences.select(F.col("silence_id"), *(F.col(c).alias(f"_{c}") for c in fields), "created_at", "expires_at")
    in_time = (F.col("starts_at") >= F.col("created_at")) & (F.col("starts_at") < F.col("expires_at"))
    if s.limit(BROADCAST_SILENCES + 1).count() <= BROADCAST_SILENCES:
        covers = in_time
        for c in fields:
            covers = covers & (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
        matches = alerts.join(F.broadcast(s), covers).select("id", "silence_id")
    else:
        begin, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("created_at", "expires_at"))
        binned = s.where("expires_at > created_at").withColumns({"_begin": begin, "_last": end - 1})
        # the bits of the length less one: that power of two isn't below the length
        binned = binned.withColumn("_size", F.when(F.col("_last") == F.col("_begin"), 0).otherwise(F.length(F.bin(F.col("_last") - F.col("_begin")))))
        binned = binned.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_begin, _size), shiftright(_last, _size))"))).drop("_begin", "_last")
        binned = stored(binned, "silences")
        kinds = {}  # the sizes in use of each set of fields
        for r in binned.groupBy("_size", *(F.col(f"_{c}").isNotNull().alias(c) for c in fields)).count().collect():  # at most 8 * 63 rows
            kinds.setdefault(tuple(r[c] for c in fields), []).append(r["_size"])
        matches = None
        times = alerts.select("id", *fields, "starts_at", F.unix_micros(F.col("starts_at").cast("timestamp")).alias("_t"))
        for kind, sizes in kinds.items():
            own = binned.where(reduce(and_, (F.col(f"_{c}").isNotNull() if has else F.col(f"_{c}").isNull() for c, has in zip(fields, kind, strict=True))))
            looks = times.withColumn("_in", F.explode(F.array(*map(F.lit, sorted(sizes))))).withColumn("_at", F.expr("shiftright(_t, _in)"))
            on = (F.col("_in") == F.col("_size")) & (F.col("_at") == F.col("_bin")) & in_time
            on = reduce(and_, (F.col(f"_{c}") == F.col(c) for c, has in zip(fields, kind, strict=True) if has), on)
            part = looks.join(own, on).select("id", "silence_id")
            matches = part if matches is None else matches.unionByName(part)
        if matches is None:
            return alerts.withColumn("silenced_by", F.lit(None).cast(silences.schema["silence_id"].dataType))
    hits = matches.groupBy("id").agg(F.min("silence_id").alias("silenced_by"))
    return alerts.join(hits, "id", "left")


def inhibit(alerts: DataFrame) -> DataFrame:
    """Firing alerts that remain: a critical one hides warnings of its name and service, ServiceDown hides all others of its service."""
    firing = alerts.where("status = 'firing'")
    critical = firing.where("severity = 'critical'").select("alertname", "service").distinct().withColumn("_crit", F.lit(True))
    down = firing.where("alertname = 'ServiceDown'").select("service").distinct().withColumn("_down", F.lit(True))
    rows = firing.join(critical, ["alertname", "service"], "left").join(down, "service", "left")
    hidden = ((F.col("severity") == "warning") & F.col("_crit").isNotNull()) | ((F.col("alertname") != "ServiceDown") & F.col("_down").isNotNull())
    return rows.where(~hidden).drop("_crit", "_down")


def with_ack(alerts: DataFrame, acks: DataFrame, as_of: str, ttl: int = 86400) -> DataFrame:
    """Acks (fingerprint, acked_at) hold for ttl seconds."""
    live = acks.where(F.col("acked_at") + F.make_dt_interval(secs=F.lit(ttl)) > F.lit(as_of).cast("timestamp")).select("fingerprint").distinct().withColumn("_ack", F.lit(True))
    return alerts.join(live, "fingerprint", "left").withColumn("acknowledged", F.col("_ack").isNotNull()).drop("_ack")


def alert_store_status(alerts: DataFrame) -> DataFrame:
    """A15"""
    return alerts.agg(F.count("*").alias("total"), F.max("starts_at").alias("last_ts"))


def _islands(evals: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that are on, with the number of rows before that are not, which all rows of a run share."""
    off = F.when(F.col("on"), 0).otherwise(1).cast("long")
    return pieces(evals, keys, "t").running_sum(["t"], {"_i": off}).plain().where("on")


def for_duration(evals: DataFrame, keys: list[str], for_s: int) -> DataFrame:
    """Evals (keys, t in seconds, on): runs of evaluations that are all on and last for_s seconds or longer."""
    runs = _islands(evals, keys).groupBy(*keys, "_i").agg(F.min("t").alias("since"), F.max("t").alias("until"))
    return runs.where(F.col("until") - F.col("since") >= for_s).select(*keys, "since", "until")


def evaluate_rules(samples: DataFrame, rules: list[tuple[str, str, str, int, str]], step: int = 60) -> DataFrame:
    """Rules as data: (alert, metric, predicate over value, seconds, severity); samples (metric, labels, t, value) on a grid of evaluations.

    All rules read the samples once: each sample is tested by the rules of its metric in one pass.
    """
    tests = F.array(*(F.struct(F.lit(a).alias("alertname"), F.lit(s).alias("severity"), F.lit(d).alias("for_s"), F.coalesce((F.col("metric") == m) & F.expr(p), F.lit(False)).alias("on"), (F.col("metric") == m).alias("applies")) for a, m, p, d, s in rules))
    evals = samples.select("labels", "t", "value", F.inline(tests)).where("applies")
    runs = _islands(evals, ["alertname", "labels"])
    spans = runs.groupBy("alertname", "severity", "labels", "for_s", "_i").agg(F.min("t").alias("starts_at"), F.max("t").alias("until"), F.max_by("value", "t").alias("value"))
    return spans.where("until - starts_at >= for_s").select("alertname", "severity", "labels", "starts_at", "value")


def notifications(alerts: DataFrame, wait: int = 30, interval: int = 300, repeat: int = 43200) -> DataFrame:
    """When each group (alertname, severity, service) is notified, and of how many new alerts.

    The first alert waits, later ones wait until interval seconds after the last notification; a group without
    news is told again (n is 0) every repeat seconds, as far as its next alert shows that it went on.
    """
    rows = alerts.where("status = 'firing'").select("alertname", "severity", "service", F.unix_seconds("starts_at").alias("t"))

    def step(s: tuple, t: int) -> tuple[tuple, list[tuple]]:
        due, sent, n = s  # when the next notification is due, when the last one went out, new alerts since
        out = []
        if due is not None and t > due:
            out.append((due, n))
            due, sent, n = None, due, 0
        if due is None and sent is None:
            due = t + wait
        elif due is None:
            while sent + repeat < t:
                sent += repeat
                out.append((sent, 0))
            due = max(t, sent + interval)
        return (due, sent, n + 1), out

    return fold_sorted(rows, ["alertname", "severity", "service"], ["t"], [], (None, None, 0), step, "sent_at bigint, n bigint", lambda s: [(s[0], s[2])])


def routes(spark: SparkSession) -> DataFrame:
    """The routing tree as a table: place, severity and alertname (null: any), receiver, wait_s, interval_s, repeat_s."""
    rows = [(i, severity, name, to, wait, GROUP_INTERVAL, repeat) for i, ((severity, name, to, repeat), wait) in enumerate(zip(RECEIVERS, ROUTE_WAITS, strict=True))]
    rows.append((len(rows), None, None, DEFAULT_RECEIVER, DEFAULT_WAIT, GROUP_INTERVAL, DEFAULT_REPEAT))
    return spark.createDataFrame(rows, "place int, severity string, alertname string, receiver string, wait_s bigint, interval_s bigint, repeat_s bigint")


def _route_of_groups(groups: DataFrame, tree: DataFrame) -> DataFrame:
    """The first route of each group (alertname, severity, service): one of four joins on what the route names, the least place of them."""
    route = F.struct("place", "receiver", "wait_s", "interval_s", "repeat_s").alias("_route")
    found = None
    for names in ((), ("severity",), ("alertname",), ("severity", "alertname")):
        own = reduce(and_, (F.col(c).isNotNull() if c in names else F.col(c).isNull() for c in ("severity", "alertname")))
        best = tree.where(own).select(*names, route).groupBy(*names).agg(F.min("_route").alias("_route"))
        part = groups.join(if_small(best), list(names)) if names else groups.crossJoin(F.broadcast(best))  # at most one row
        part = part.select("alertname", "severity", "service", "_route")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("alertname", "severity", "service").agg(F.min("_route").alias("_route")).where("_route IS NOT NULL").select("alertname", "severity", "service", "_route.*")


def _next_tick(t: Column, first: Column, interval: Column) -> Column:
    """The first of first, first + interval, ... that is not before t."""
    return first + F.greatest(F.ceil((t - first) / interval), F.lit(0)).cast("bigint") * interval


def routed_notifications(alerts: DataFrame, tree: DataFrame, as_of: int | None = None) -> DataFrame:
    """E19 with routes: what each group (alertname, severity, service) is told, when, by which receiver.

    alerts: id, alertname, severity, service, fingerprint, status (firing or resolved), starts_at: the changes of each fingerprint (in
    order of time, then id; a repeated status changes nothing).  tree: as routes gives it.  A group opens when its first alert
    fires, and is looked at after its route's wait and then every interval: a look that finds alerts that began since the last notification
    tells of them ("firing", n of them); one that finds nothing new tells again ("repeat") when repeat seconds have passed; the first
    that finds all resolved tells that, if anything was told before ("resolved"), and closes the group, which then is silent.
    Open groups repeat up to as_of (seconds; null: the last change of all).  Rows without a time, and groups of no route, are passed over.

    Changes are counted by second before anything else, so what follows sees seconds: running counts of the firing give the spans
    in which a group fires (pieces of time, no task per group).  Whether a span finds the group of the one before still open
    depends on when that was opened: a fold over spans, cut wherever a group is surely closed.  Looks and repeats then are
    arithmetic.
    """
    group = ["alertname", "severity", "service"]
    changes = alerts.where("status IN ('firing', 'resolved') AND starts_at IS NOT NULL").select(
        *(F.coalesce(c, F.lit("")).alias(c) for c in group), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), "id", F.unix_seconds(F.col("starts_at").cast("timestamp")).alias("t"), F.unix_micros(F.col("starts_at").cast("timestamp")).alias("_at"), (F.col("status") == "firing").alias("_on")
    )
    seen = pieces(changes, [*group, "fingerprint"], "_at").last_before(["_at", "id"], {"_was": F.col("_on")}).plain()
    was = F.coalesce("_was", F.lit(False))
    turns = seen.where(F.col("_on") != was)
    seconds = stored(turns.groupBy(*group, "t").agg(F.sum(F.when(F.col("_on"), 1).otherwise(-1)).alias("_step"), F.count_if("_on").alias("_new")), "alert-seconds")

    counted = pieces(seconds, group, "t").running_sum(["t"], {"_active": F.col("_step")})
    opens = (F.col("_active") > 0) & (F.col("_active") == F.col("_step"))
    lived = stored(counted.running_sum(["t"], {"_span": F.when(opens, 1).otherwise(0)}).plain().where("_active > 0 OR _step < 0"), "alert-spans")
    spans = lived.groupBy(*group, "_span").agg(F.min("t").alias("start"), F.max(F.when(F.col("_active") == 0, F.col("t"))).alias("end"))
    spans = spans.join(if_small(_route_of_groups(spans.select(*group).distinct(), tree)), group)
    # a pause that is no shorter than wait and interval holds a look
    paused = pieces(spans, group, "start").last_before(["start"], {"_ended": F.struct("end")})
    closed = F.col("start") - F.col("_ended.end") > F.greatest("wait_s", "interval_s")
    cut = paused.running_sum(["start"], {"_cut": F.when(closed, 1).otherwise(0)}).plain()

    def step(open_at: tuple | None, start: int, span: int, end: int | None, wait: int, interval: int) -> tuple[tuple | None, list[tuple]]:
        if open_at is not None:
            opened, ended = open_at
            first = opened + wait
            look = first + max(0, -((first - ended) // interval)) * interval
            if start > look:
                open_at = None
        opened = start if open_at is None else open_at[0]
        return (opened, end), [(span, opened)]

    opened = stored(fold_sorted(cut, [*group, "_cut"], ["start"], ["_span", "end", "wait_s", "interval_s"], None, step, "_span bigint, opened bigint").drop("_cut").join(spans, [*group, "_span"]), "alert-groups")
    first, interval = F.col("opened") + F.col("wait_s"), F.col("interval_s")
    by = [*group, "opened"]
    route = ["receiver", "wait_s", "interval_s", "repeat_s"]
    last = lived.agg(F.max("t").alias("_last")) if as_of is None else None
    lives = opened.groupBy(*by, *route).agg(F.max("end").alias("_end"), F.count_if(F.col("end").isNull()).alias("_open"))
    lives = lives.withColumn("_close", F.when(F.col("_open") == 0, _next_tick(F.col("_end"), first, interval)))
    lives = lives.withColumn("_until", F.lit(as_of).cast("bigint")) if last is None else lives.crossJoin(F.broadcast(last)).withColumnRenamed("_last", "_until")
    lives = lives.where("_close IS NULL OR _close > opened + wait_s")
    news = lived.where("_new > 0").join(opened.select(*by, "_span"), [*group, "_span"]).groupBy(*by, "t").agg(F.sum("_new").alias("_new"))
    looks = news.join(lives, by).withColumn("sent_at", _next_tick(F.col("t"), first, interval))
    told = looks.groupBy(*by, "receiver", "interval_s", "repeat_s", "sent_at", "_close", "_until").agg(F.sum("_new").alias("n")).where("_close IS NULL OR sent_at < _close")
    following = F.lead("sent_at").over(Window.partitionBy(*by).orderBy("sent_at"))
    every = F.ceil(F.col("repeat_s") / interval).cast("bigint") * interval
    told = told.withColumns({"_next": F.coalesce(following, "_close", F.col("_until") + 1), "_every": every})
    again = F.greatest(F.expr("(_next - sent_at - 1) DIV _every"), F.lit(0))
    shown = told.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), again)))
    sent = shown.select(*group, "receiver", (F.col("sent_at") + F.col("_i") * F.col("_every")).alias("sent_at"), F.when(F.col("_i") == 0, "firing").otherwise("repeat").alias("kind"), F.when(F.col("_i") == 0, F.col("n")).otherwise(0).alias("n"))
    ends = lives.where("_close IS NOT NULL").select(*group, "receiver", F.col("_close").alias("sent_at"), F.lit("resolved").alias("kind"), F.lit(0).cast("bigint").alias("n"))
    return sent.unionByName(ends)
