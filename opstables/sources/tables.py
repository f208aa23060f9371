"""Sources and sinks: tables with declared schemas, JSON snapshots, alert payloads, DAG files, logs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the durable tables.
SCHEMAS: dict[str, str] = {
    "tasks": "task_id string, tenant_id string, task_type string, dag_id string, status string, priority string, cluster_id string, current_step string, input_data string, output_data string, error_message string, metadata_json string, callback_url string, idempotency_key string, timeout_seconds int, max_retries int, attempt int, scheduled_at timestamp, cron_expr string, created_at timestamp, updated_at timestamp",
    "task_runs": "id bigint, task_id string, run_key string, tenant_id string, status string, attempt int, worker_id string, lease_id string, trigger_source string, input_json string, error_message string, created_at timestamp, updated_at timestamp",
    "dag_runs": "id bigint, dag_id string, run_key string, tenant_id string, status string, trigger_source string, input_json string, error_message string, created_at timestamp, updated_at timestamp",
    "task_events": "id bigint, task_id string, run_key string, event_type string, event_payload string, created_at timestamp",
    "callback_outbox": "id bigint, task_id string, tenant_id string, callback_url string, payload_json string, delivery_status string, attempt_count int, next_attempt_at timestamp, last_error string, acknowledged_by string, acknowledged_at timestamp, created_at timestamp, updated_at timestamp",
    "operator_actions": "id bigint, actor string, action_type string, target_type string, target_id string, reason string, payload_json string, created_at timestamp",
    "schedules": "schedule_id string, tenant_id string, cron_expr string, task_template string, enabled boolean, last_triggered_at timestamp, next_fire_at string, created_at timestamp, updated_at timestamp",
    "alerts": "id bigint, alertname string, severity string, service string, status string, fingerprint string, starts_at timestamp, ends_at timestamp",
    "heartbeats": "node_id string, ts timestamp",
    "chunks": "stream_id string, seq bigint, raw string, ts timestamp",
    "samples": "metric string, labels map<string,string>, ts timestamp, value double",
}
DAG_SCHEMA = "dag_id string, tenant_id string, steps array<struct<step_name: string, capability: string, step_kind: string, depends_on: array<string>, condition: string, timeout_seconds: int, on_failure: string, fallback_output: map<string,string>>>"
LOG_SCHEMA = "timestamp string, level string, logger string, message string, module string, lineno int"


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A durable table with its declared schema (or that given).

    fmt jdbc takes the URL as its path, dbtable and, to read in parallel, partitionColumn and bounds as options; the
    declared types are what the driver's are read as (customSchema).
    """
    declared = schema or SCHEMAS[name]
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=path, customSchema=declared, **options).load().select(*(c.split()[0] for c in declared.split(", ")))
    return spark.read.schema(declared).options(**options).format(fmt).load(path)


def parse_cache_snapshot(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """JSON objects as columns; empty, malformed and other values are skipped."""
    objects = df.where(F.trim(raw).startswith("{"))
    return objects.withColumn("_p", F.from_json(raw, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("_p IS NOT NULL AND _p._bad IS NULL").select("_p.*").drop("_bad")


def live(df: DataFrame, time: str, ttl: int, as_of: str) -> DataFrame:
    """S3: rows younger than ttl seconds."""
    return df.where(F.col(time).cast("timestamp") + F.make_dt_interval(secs=F.lit(ttl)) > F.lit(as_of).cast("timestamp"))


def read_dag_steps(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of DAGs, a row a step."""
    dags = spark.read.schema(DAG_SCHEMA).json(path, multiLine=True)
    return dags.select("dag_id", "tenant_id", F.posexplode("steps").alias("idx", "step")).select("dag_id", "tenant_id", "idx", "step.*")


def explode_alerts(df: DataFrame, raw: str) -> DataFrame:
    """Webhook payloads, a row an alert."""
    schema = "alerts array<struct<status: string, labels: map<string,string>, annotations: map<string,string>, startsAt: string, endsAt: string, fingerprint: string>>"
    rest = [c for c in df.columns if c != raw]
    return df.select(*rest, F.explode(F.from_json(raw, schema)["alerts"]).alias("_a")).select(*rest, "_a.*")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines; all other fields as the map `extras`; lines that aren't JSON objects are skipped."""
    known = [x.split()[0] for x in LOG_SCHEMA.split(", ")]
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    rows = lines.select(F.from_json("value", LOG_SCHEMA).alias("_l"), F.from_json("value", "map<string,string>").alias("_m")).where("_m IS NOT NULL")
    return rows.select("_l.*", F.map_filter("_m", lambda k, _: ~k.isin(*known)).alias("extras"))


def stream_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Files of a table as a stream."""
    return spark.readStream.schema(SCHEMAS[name]).options(**options).format(fmt).load(path)


def append_events(df: DataFrame, path: str) -> None:
    """Rows added to a table of files."""
    df.write.mode("append").parquet(path)
