"""Streaming operators run over the tables' files until these are read (trigger availableNow)."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from opstables.operators import fsm
from opstables.plans import fixtures, recursion
from opstables.plans.registry import ORACLES, QUERIES, plain, query
from opstables.plans.state import HEALTH_SQL
from opstables.sources.scratch import shared_dir
from opstables.sources.upserts import KeyedTable
from opstables.streaming import operators as T


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream (the pattern fits the one name)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet")


def run(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has given when its input is used up."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = out.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))
    q = writer.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _register(name: str, table: str, build, mode: str = "append", views: str = "", sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(run(spark, build(_stream(spark, sf_dir, table)), mode))
    if sql:
        ORACLES[name] = fixtures.with_views(tuple(views.split()), sql)


def _events(s):
    names = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'requeue' END"
    return s.select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.expr(names).alias("event"), F.col("ts").cast("timestamp").alias("created_at"), "value")


def _checks(s):
    return s.select(F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))


# a node that stays silent is offline, too, as far as the last event of all (the watermark) tells
_LIVENESS = """WITH g AS (SELECT entity, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, lead(epoch_us(ts)) OVER w AS nx FROM health_checks WINDOW w AS (PARTITION BY entity ORDER BY ts))
  SELECT entity AS node, t AS at, 'online' AS state FROM g WHERE p IS NULL OR t - p > 86400000000
  UNION ALL SELECT entity, t + 86400000000, 'offline' FROM g WHERE coalesce(nx - t > 86400000000, (t + 86400000000) // 1000 < (SELECT max(t) // 1000 FROM g))"""
_register(
    "t1_liveness", "events", lambda s: T.liveness(_checks(s).withColumnRenamed("entity", "node"), 86400).withColumn("at", F.round(F.col("at") * 1_000_000).cast("bigint")), views="health_checks", sql=_LIVENESS,
)


@query("t1_liveness_batch", "health_checks", _LIVENESS)
def _(checks):
    as_of = F.unix_micros(F.lit(checks.agg(F.max("ts")).first()[0]))  # one value
    return T.liveness_batch(checks.withColumnRenamed("entity", "node"), 86400, as_of)


_register("t6_limiter", "events", lambda s: T.limiter(_checks(s), 86400, 2), views="health_checks", sql=recursion.limiter(86400, 2, "entity, id, allowed"))
_register("t6_breaker", "events", lambda s: T.breaker(_checks(s), 2, 86400.0), views="health_checks", sql=recursion.breaker(2, 86400))
_register("t6_client_breaker", "events", lambda s: T.client_breaker(_checks(s), 2, 43200.0), views="health_checks", sql=recursion.client_breaker(2, 43200))
_register("t6_health", "events", lambda s: T.health(_checks(s)), views="health_checks", sql=HEALTH_SQL)
_register("t6_task_machine", "events", lambda s: T.machine(_events(s).drop("value"), fsm.TASK_TABLE, "pending"), views="task_events", sql=recursion.machine(*recursion.TASKS, columns=recursion.SHOWN))
_register("t6_node_machine", "events", lambda s: T.machine(_events(s).drop("value").withColumn("event", F.expr(recursion.NODE_EVENT)), fsm.NODE_TABLE, "idle"), views="task_events", sql=recursion.machine(*recursion.NODES, columns=recursion.SHOWN))
_register(
    "t8_alert_lifecycle", "events",
    lambda s: T.alert_lifecycle(s.select(F.col("user_id").cast("string").alias("labels"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 30).alias("on")), 86400), sql=recursion.lifecycle(86400),
)
_CHAIN = [("Slow", "mean > 52", 21600, "warning"), ("Failing", "bad / n > 0.3", 0, "critical")]
_register(
    "t8_alert_changes", "events",
    lambda s: T.alert_changes(
        s.select(F.expr("concat('cap-', user_id % 8)").alias("capability"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value"), "at", ["capability"],
        {"n": F.count("*"), "bad": F.count_if(F.col("event_type") == "error"), "mean": F.avg("value")}, _CHAIN, "6 hours", delay="0 seconds",
    ).withColumn("at", F.col("at").cast("bigint")), sql=recursion.alert_changes(_CHAIN, 21600),
)
_register("t5_idempotency", "events", lambda s: T.deduplicated(_events(s), "created_at", ["task_id", "event"], "300 seconds").select("task_id", "event"), views="task_events", sql="SELECT DISTINCT task_id, event FROM task_events")
_register(
    "t7_windowed_counts", "events", lambda s: T.windowed_counts(_events(s), "created_at", ["event"], "1 hour"), mode="complete", views="task_events",
    sql="SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, created_at)) AS window_start, event, count(*) AS n FROM task_events GROUP BY ALL",
)
_register(
    "t7_sliding_rates", "events", lambda s: T.windowed_rates(_events(s), "created_at", ["event"], "1 hour", "20 minutes").withColumn("rate", F.round("rate", 9)), mode="complete", views="task_events",
    sql="""SELECT epoch_us(time_bucket(INTERVAL 20 MINUTE, created_at) - k * INTERVAL 20 MINUTE) AS window_start, event, round(count(*) / 3600, 9) AS rate FROM task_events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL""",
)
_BOUNDS = (5.0, 20.0, 60.0, 120.0)
_register(
    "t7_histograms", "events",
    lambda s: T.windowed_histogram(_events(s), "created_at", "value", ["event"], _BOUNDS, "1 day").withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))), mode="complete", views="",
    sql=f"""WITH e AS (SELECT CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'requeue' END AS event, value, CAST(ts AS TIMESTAMP) AS made FROM events)
       SELECT epoch_us(time_bucket(INTERVAL 1 DAY, made)) AS window_start, event, coalesce(nullif(CAST(le AS VARCHAR), 'inf'), '+Inf') AS le, count(*) FILTER (value <= le) AS cumulative, count(*) AS count
       FROM e, (SELECT unnest([{', '.join(map(str, _BOUNDS))}, CAST('inf' AS DOUBLE)]) AS le) GROUP BY 1, 2, le""",
)
_register("t10_totals", "events", lambda s: T.totals(_events(s), ["event"]), mode="complete", views="task_events", sql="SELECT event, count(*) AS n FROM task_events GROUP BY event")
# every fifth turn ends a stream (in an error if a system says it), every fifth is no JSON; the gaps of some streams are over the idle time
_CHUNK_COLUMNS = """conv_id AS stream_id, turn AS seq, 1704067200 + conv_id * 100 + turn * (5 + conv_id % 7 * 7) AS t,
  CASE WHEN turn % 5 = 4 AND role = 'system' THEN '{"__done__":true,"__error__":"boom"}' WHEN turn % 5 = 4 THEN concat('{"__done__":true,"summary":{"turn":"', turn, '"}}')
       WHEN turn % 5 = 2 THEN 'no json' ELSE concat('{"n":', turn, '}') END AS raw"""
_CHUNKS = f"""WITH c AS (SELECT {_CHUNK_COLUMNS}, turn % 5 = 4 AS done, role = 'system' AS wrong FROM conversations),
  x AS (SELECT *, lead(t) OVER w IS NULL AS latest, t > least(coalesce(lag(t) OVER w, t) + 30, min(t) OVER (PARTITION BY stream_id) + 3600) AS late, max(t) OVER () AS as_of FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY t, seq)),
  y AS (SELECT *, coalesce(max(CAST(done OR late AS INT)) OVER (PARTITION BY stream_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM x)
  SELECT stream_id, CASE WHEN NOT late THEN seq END AS seq, CASE WHEN late OR (done AND wrong) THEN 'failed' WHEN done THEN 'completed' ELSE 'chunk' END AS status,
         CASE WHEN late THEN 'idle' WHEN done AND wrong THEN 'boom' WHEN done THEN NULL WHEN raw = 'no json' THEN '{{"__raw__":"no json"}}' ELSE raw END AS payload,
         CASE WHEN done AND NOT wrong AND NOT late THEN CAST(seq AS VARCHAR) END AS turn FROM y WHERE ended = 0
  UNION ALL SELECT stream_id, NULL, 'failed', 'idle', NULL FROM y WHERE ended = 0 AND latest AND NOT done AND NOT late AND t + 30 < as_of"""


def _chunk_rows(s):
    return s.selectExpr(*map(str.strip, _CHUNK_COLUMNS.split(",", 3))).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def _shown(found):
    return found.select("stream_id", "seq", "status", "payload", F.try_element_at("summary", F.lit("turn")).alias("turn"))


@query("t4_chunks", "conversations", _CHUNKS)
def _(conversations):
    rows = _chunk_rows(conversations)
    as_of = F.lit(rows.agg(F.unix_seconds(F.max("ts"))).first()[0])  # one value
    return _shown(T.chunks_batch(rows, as_of))


_register("t4_chunk_stream", "conversations", lambda s: _shown(T.chunks(_chunk_rows(s))), sql=_CHUNKS)


def _in_batches(spark: SparkSession, base: str, writer: Callable[[DataFrame], DataStreamWriter], *parts: DataFrame) -> None:
    """Runs the writer's stream over each part as a batch of its own, in order; a part is as many files as its tasks write, and all are one batch.

    The stream goes on from its checkpoint when the next part is there.
    """
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{base}/in")
        q = writer(stream).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches, each with events of all times; the last one by time stays."""
    base = _folder(spark)
    events = _events(spark.read.parquet(f"{sf_dir}/events.parquet")).drop("value")
    table = KeyedTable(spark, f"{base}/latest", ["task_id"], ("created_at", "id"))
    _in_batches(spark, base, lambda s: T.latest_table(s, table, ["task_id", "event", "created_at", "id"]), *(events.where(f"id % 3 = {i}") for i in (2, 0, 1)))
    return table.read().select("task_id", "event")


QUERIES["t11_latest_status"] = _t11
ORACLES["t11_latest_status"] = fixtures.with_views(
    ("task_events",), "SELECT task_id, event FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) AS r FROM task_events) WHERE r = 1"
)


def _t3(part: str):
    """Three batches of delivery outcomes of all callbacks against the outbox: its rows after them (t3), or the dead letters that are retained (t12)."""

    def run_it(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _folder(spark)
        outbox, dead = KeyedTable(spark, f"{base}/outbox", ["id"]), KeyedTable(spark, f"{base}/dead", ["id"])
        outbox.merge(fixtures.view(spark, sf_dir, "callback_outbox").select("id", "delivery_status", F.col("attempt_count").cast("int").alias("attempt_count"), F.lit(None).cast("bigint").alias("next_attempt_us")))
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        outcomes = (events.selectExpr("event_id AS id", f"(event_id + {i}) % 5 = 0 AS delivered") for i in range(3))
        _in_batches(spark, base, lambda s: T.outbox_updates(s, outbox, fixtures.EVENTS_AS_OF, dead), *outcomes)
        if part == "rows":
            return outbox.read()
        letters = dead.read().withColumn("died_at", F.expr("CASE WHEN id % 2 = 0 THEN died_at - INTERVAL 31 DAY ELSE died_at END"))
        return plain(T.retained_dead_letters(letters, fixtures.EVENTS_AS_OF).select("id", "attempt_count"))

    return run_it


# batch i delivers the ids of which 5 divides id + i; the eighth attempt is the last
_T3_FROM = f"""SELECT id, CASE WHEN delivery_status <> 'pending' THEN delivery_status WHEN d <= 2 AND d <= p THEN 'delivered' WHEN p <= 2 THEN 'dead_letter' ELSE 'pending' END AS delivery_status,
    CAST(attempt_count + CASE WHEN delivery_status <> 'pending' THEN 0 ELSE least(d, p, 2) + 1 END AS INT) AS attempt_count,
    CASE WHEN delivery_status = 'pending' AND d > 2 AND p > 2 THEN epoch_us(TIMESTAMP '{fixtures.EVENTS_AS_OF}') + CAST([10, 30, 60, 300, 900, 1800, 3600][least(attempt_count + 3, 7)] AS BIGINT) * 1000000 END AS next_attempt_us
    FROM (SELECT *, (5 - id % 5) % 5 AS d, greatest(0, 7 - attempt_count) AS p FROM callback_outbox)"""
QUERIES["t3_outbox_stream"], QUERIES["t12_dead_letters"] = _t3("rows"), _t3("dead")
ORACLES["t3_outbox_stream"] = fixtures.with_views(("callback_outbox",), _T3_FROM)
ORACLES["t12_dead_letters"] = fixtures.with_views(("callback_outbox",), f"SELECT id, attempt_count FROM ({_T3_FROM}) WHERE delivery_status = 'dead_letter' AND id % 2 <> 0 AND id IN (SELECT id FROM callback_outbox WHERE delivery_status = 'pending')")


def _t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks at the times of the events, in two batches of the same latest tick: the tasks that schedules give, once, and where the fired ones go next."""
    base = _folder(spark)
    schedules, fired = KeyedTable(spark, f"{base}/schedules", ["schedule_id"]), KeyedTable(spark, f"{base}/fired", ["idempotency_key"])
    schedules.merge(fixtures.view(spark, sf_dir, "schedules").withColumn("cron_expr", F.expr("CASE WHEN schedule_id % 2 = 0 THEN '30 6 1 * *' ELSE '0 0 29 2 *' END")))
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("timestamp"))
    _in_batches(spark, base, lambda s: T.cron_ticks(s, schedules, fired), ticks, ticks)
    return fired.read().select("schedule_id", "tenant_id", "idempotency_key").join(schedules.read().select("schedule_id", "next_fire_at"), "schedule_id")


QUERIES["t9_cron_ticks"] = _t9
ORACLES["t9_cron_ticks"] = fixtures.with_views(
    ("schedules",),
    """SELECT schedule_id, tenant_id, concat('cron:', CAST(schedule_id AS VARCHAR), ':', CAST(epoch_us(last) // 60000000 * 60 AS VARCHAR)) AS idempotency_key,
              CASE WHEN schedule_id % 2 = 0 THEN '2024-02-01T06:30:00' ELSE '2024-02-29T00:00:00' END AS next_fire_at
       FROM schedules, (SELECT max(CAST(ts AS TIMESTAMP)) AS last FROM events) WHERE enabled AND try_cast(next_fire_at AS TIMESTAMP) <= date_trunc('second', last)""",
)


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that were acted on of late."""
    return fixtures.view(spark, sf_dir, "orders").where("o_custkey % 9 = 0").selectExpr("o_orderkey AS task_id")


def _t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache in two batches that share a third of the tasks, which are acted on once."""
    base = _folder(spark)
    cache = fixtures.view(spark, sf_dir, "task_cache").drop("tenant_id", "callback_url")
    actions = KeyedTable(spark, f"{base}/actions", ["task_id"])
    leases = fixtures.view(spark, sf_dir, "leases")
    _in_batches(spark, base, lambda s: T.stuck_actions(s, leases, lambda: fixtures.TASKS_AS_OF, actions, lambda: orders_of(spark, sf_dir)), cache.where("task_id % 3 <> 0"), cache.where("task_id % 3 <> 1"))
    return actions.read().select("task_id", "action", "delay_ms")


QUERIES["t2_stuck_actions"] = _t2
ORACLES["t2_stuck_actions"] = fixtures.with_views(
    ("task_cache", "leases"),
    f"""SELECT task_id, CASE WHEN attempt < max_retries THEN 'requeue' ELSE 'fail' END AS action, CASE WHEN attempt < max_retries THEN least(600000, 10000 * CAST(pow(2, attempt) AS BIGINT)) END AS delay_ms
        FROM task_cache WHERE status IN ('running', 'queued') AND created_at <= TIMESTAMP '{fixtures.TASKS_AS_OF}' - INTERVAL 300 SECOND AND task_id NOT IN (SELECT task_id FROM leases)
          AND task_id NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 0)""",
)
