"""Queries of opstables.operators.policy and the alert decisions."""

from pyspark.sql import functions as F

from opstables.operators import alerts as A
from opstables.operators import audit, policy
from opstables.operators import reconcile as R
from opstables.plans.fixtures import EVENTS_AS_OF
from opstables.plans.registry import query


@query(
    "p9_validate", "orders",
    """WITH q AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('t', 129) ELSE 'train' END AS task_type, CAST(o_orderkey % 5 * 30000 AS INT) AS timeout_seconds, CAST(o_orderkey % 25 AS INT) AS max_retries,
                         o_orderkey % 4 = 0 AS both_times, o_orderkey % 3 = 0 AS bad_sha, o_orderkey % 7 = 0 AS no_entry FROM orders)
       SELECT id, concat_ws('|', CASE WHEN length(task_type) NOT BETWEEN 1 AND 128 THEN 'task_type must have 1 to 128 characters' END, CASE WHEN timeout_seconds NOT BETWEEN 1 AND 86400 THEN 'timeout_seconds must be 1 to 86400' END,
              CASE WHEN max_retries NOT BETWEEN 0 AND 20 THEN 'max_retries must be 0 to 20' END, CASE WHEN both_times THEN 'scheduled_at excludes delay_seconds' END,
              CASE WHEN bad_sha THEN 'artifact_sha256 must have 64 characters' END, CASE WHEN no_entry THEN 'artifact needs an entrypoint' END) AS violations FROM q""",
)
def _(orders):
    requests = orders.selectExpr(
        "o_orderkey AS id", "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN repeat('t', 129) ELSE 'train' END AS task_type", "CAST(o_orderkey % 5 * 30000 AS INT) AS timeout_seconds",
        "CAST(o_orderkey % 25 AS INT) AS max_retries", "CASE WHEN o_orderkey % 4 = 0 THEN 'now' END AS scheduled_at", "5 AS delay_seconds", "'http://a' AS artifact_url",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'abc' ELSE repeat('0', 64) END AS artifact_sha256", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'main' END AS entrypoint",
    )
    return policy.validate(requests).select("id", F.array_join("violations", "|").alias("violations"))


@query(
    "p10_url_verdict", "pages",
    r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.org/a' WHEN 2 THEN 'http://localhost:80/x' WHEN 3 THEN 'https://10.1.2.3/x' WHEN 4 THEN 'http://172.20.0.1/' ELSE 'https:///nothing' END AS url FROM pages),
            h AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[^/]*//([^/:?#]*)', 1)) AS host FROM u)
       SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN 'unsupported scheme' WHEN host = '' THEN 'no hostname' WHEN host IN ('localhost', '127.0.0.1', '::1', '0.0.0.0') THEN 'blocked hostname'
              WHEN regexp_matches(host, '^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.)') THEN 'private address' ELSE 'ok' END AS verdict FROM h""",
)
def _(pages):
    url = F.expr("CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.org/a' WHEN 2 THEN 'http://localhost:80/x' WHEN 3 THEN 'https://10.1.2.3/x' WHEN 4 THEN 'http://172.20.0.1/' ELSE 'https:///nothing' END")
    return pages.select("page_id", policy.url_verdict(url).alias("verdict"))


_OPS = "id, actor_role, reason, CASE id % 3 WHEN 0 THEN 'force_lease_eviction' WHEN 1 THEN 'force_replay_without_reason' ELSE 'pause_queue' END AS operation"


@query(
    "p11_governance", "operator_actions",
    f"""WITH q AS (SELECT {_OPS} FROM operator_actions) SELECT id, operation <> 'pause_queue' AS high_risk, operation <> 'pause_queue' AS strong_audit,
        CASE WHEN operation <> 'pause_queue' THEN 'admin' ELSE 'operator,admin' END AS allowed_roles FROM q""",
)
def _(actions):
    return policy.govern(actions.selectExpr(*_OPS.split(", ", 3))).select("id", "high_risk", "strong_audit", F.array_join("allowed_roles", ",").alias("allowed_roles"))


@query(
    "p12_force_verdict", "operator_actions",
    f"""WITH q AS (SELECT {_OPS} FROM operator_actions), v AS (SELECT *, CASE WHEN actor_role NOT IN ('operator', 'admin') OR (operation <> 'pause_queue' AND actor_role <> 'admin') THEN 'role_too_low'
          WHEN operation <> 'pause_queue' AND coalesce(reason, '') = '' THEN 'reason_missing' END AS error FROM q)
        SELECT id, operation, error, error IS NULL AS ok, CASE WHEN error IS NULL THEN concat('force_', operation) END AS audit_action FROM v""",
)
def _(actions):
    return policy.force_verdict(actions.selectExpr(*_OPS.split(", ", 3))).select("id", "operation", "error", "ok", "audit_action")


@query(
    "p13_callback_replay_verdict", "operator_actions callback_outbox",
    """WITH q AS (SELECT id AS request_id, id + 1 AS outbox_id, reason, actor_role FROM operator_actions),
       j AS (SELECT q.*, delivery_status AS s FROM q LEFT JOIN callback_outbox o ON o.id = outbox_id)
       SELECT request_id, outbox_id, s IS NOT NULL AND reason IS NOT NULL AND s <> 'pending' AND (s <> 'delivered' OR actor_role = 'admin') AS allowed,
              CASE WHEN s IS NULL THEN 'callback_unknown' ELSE coalesce(nullif(concat_ws('|', CASE WHEN reason IS NULL THEN 'reason_missing' END,
                CASE WHEN s = 'pending' THEN 'already_pending' END, CASE WHEN s = 'delivered' AND actor_role = 'admin' THEN 'delivered_admin_override' END,
                CASE WHEN s = 'delivered' AND actor_role <> 'admin' THEN 'delivered_needs_admin' END), ''), 'allowed') END AS reasons FROM j""",
)
def _(actions, outbox):
    requests = actions.selectExpr("id AS request_id", "id + 1 AS outbox_id", "reason", "actor_role")
    return policy.callback_replay_verdict(requests, outbox).withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "p14_replay_verdict", "operator_actions leases",
    f"""WITH n AS (SELECT target_id, count(*) AS n FROM operator_actions WHERE action_type = 'task_replay_requested'
                   AND created_at BETWEEN TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 864000 SECOND AND TIMESTAMP '{EVENTS_AS_OF}' GROUP BY 1),
        j AS (SELECT id AS request_id, a.target_id AS task_id, reason, actor_role = 'admin' AS adm, l.task_id IS NOT NULL AS lease, coalesce(n, 0) AS n
              FROM operator_actions a LEFT JOIN leases l ON l.task_id = a.target_id LEFT JOIN n ON n.target_id = a.target_id)
        SELECT request_id, task_id, CASE WHEN n >= 3 THEN false WHEN lease THEN adm ELSE reason IS NOT NULL END AS allowed,
               coalesce(nullif(concat_ws('|', CASE WHEN reason IS NULL THEN 'reason_missing' END, CASE WHEN lease THEN 'lease_active' END,
                 CASE WHEN lease AND adm THEN 'lease_admin_override' END,
                 CASE WHEN n >= 3 THEN 'rate_exceeded' END), ''), 'allowed') AS reasons FROM j""",
)
def _(actions, leases):
    recent = R.recent_replays(actions, EVENTS_AS_OF, 864000)
    requests = actions.selectExpr("id AS request_id", "target_id AS task_id", "reason", "actor_role")
    return policy.replay_verdict(requests, leases, recent).withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "p15_list_alerts", "alerts",
    "SELECT id, alertname FROM (SELECT * FROM alerts ORDER BY starts_at DESC, id DESC LIMIT 200) WHERE status = 'firing' AND severity = 'warning' AND service = 'task-api'",
)
def _(alerts):
    return A.list_alerts(alerts, 200, "firing", "warning", "task-api").select("id", "alertname")


@query(
    "p16_route_alerts", "alerts",
    """SELECT id, CASE severity WHEN 'critical' THEN 'chat,webhook' WHEN 'warning' THEN 'chat' ELSE 'webhook' END || CASE WHEN service = 'ops-api' AND severity = 'warning' THEN ',webhook' ELSE '' END
              || CASE WHEN alertname = 'ServiceDown' THEN ',email' ELSE '' END AS channels FROM alerts""",
)
def _(alerts):
    routed = A.route_alerts(alerts, (({"service": "ops-api", "severity": "warning"}, "webhook"), ({"alertname": "ServiceDown"}, "email")))
    return routed.select("id", F.array_join("channels", ",").alias("channels"))


@query(
    "p17_route_receiver", "alerts",
    """SELECT id, CASE severity WHEN 'critical' THEN 'critical-ops' WHEN 'warning' THEN 'warning-ops' ELSE 'default-webhook' END AS receiver,
              CASE WHEN severity = 'critical' AND alertname = 'ServiceDown' THEN 300 WHEN severity = 'critical' THEN 600 WHEN severity = 'warning' THEN 1800 ELSE 21600 END AS repeat_seconds FROM alerts""",
)
def _(alerts):
    return A.route_receiver(alerts).select("id", "receiver", "repeat_seconds")


@query(
    "p16_extra_labels", "alerts",
    "SELECT id, CASE severity WHEN 'critical' THEN 'pager' ELSE 'webhook' END || CASE WHEN fingerprint LIKE '%7' AND service = 'task-api' THEN ',email' ELSE '' END AS channels FROM alerts",
)
def _(alerts):
    rows = alerts.withColumn("extra", F.create_map(F.lit("shard"), F.substring("fingerprint", -1, 1), F.lit("service"), F.lit("of the map")))
    routed = A.route_alerts(rows, (({"shard": "7", "service": "task-api"}, "email"),), {"critical": ("pager",)})
    return routed.select("id", F.array_join("channels", ",").alias("channels"))


@query(
    "p18_render_email", "alerts",
    """SELECT id, concat('[', upper(status), '] ', upper(severity), ': ', alertname) AS subject,
              concat_ws(chr(10), 'status: ' || status, 'severity: ' || severity, 'service: ' || service, 'since: ' || strftime(starts_at, '%Y-%m-%d %H:%M:%S'), 'summary: ' || alertname || ' fired',
                        concat('labels: alertname=', alertname, ', severity=', severity, ', service=', service, ', fingerprint=', fingerprint)) AS body FROM alerts""",
)
def _(alerts):
    return A.render_alert(alerts.withColumn("summary", F.concat("alertname", F.lit(" fired"))), "email")


@query(
    "p18_render_chat", "alerts",
    "SELECT id, concat_ws(chr(10), concat(status, ' ', severity, ' ', alertname), 'service: ' || service, 'since: ' || strftime(starts_at, '%Y-%m-%d %H:%M:%S')) AS message FROM alerts",
)
def _(alerts):
    return A.render_alert(alerts, "chat")


@query(
    "p18_render_webhook", "alerts",
    """SELECT id, concat('{"alertname":"', alertname, '","severity":"', severity, '","service":"', service, '","fingerprint":"', fingerprint, '","status":"', status, '","starts_at":"', strftime(starts_at, '%Y-%m-%dT%H:%M:%S'), '"}') AS payload FROM alerts""",
)
def _(alerts):
    return A.render_alert(alerts.withColumn("starts_at", F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss")), "webhook")


@query(
    "c11_silences", "alerts nation",
    """WITH s AS (SELECT n_nationkey AS silence_id, CASE WHEN n_nationkey % 2 = 0 THEN 'rule-1' END AS alertname, CASE WHEN n_nationkey % 3 = 0 THEN 'warning' END AS severity, CASE WHEN n_nationkey % 5 = 0 THEN 'ops-api' END AS service,
                         TIMESTAMP '2024-01-01 00:00:00' + n_nationkey * INTERVAL 1 DAY AS a, TIMESTAMP '2024-01-01 06:00:00' + n_nationkey * INTERVAL 1 DAY AS b FROM nation)
       SELECT id, min(silence_id) AS silenced_by FROM alerts t LEFT JOIN s ON (s.alertname IS NULL OR s.alertname = t.alertname) AND (s.severity IS NULL OR s.severity = t.severity)
         AND (s.service IS NULL OR s.service = t.service) AND starts_at >= a AND starts_at < b GROUP BY id""",
)
def _(alerts, nation):
    silences = nation.selectExpr(
        "n_nationkey AS silence_id", "CASE WHEN n_nationkey % 2 = 0 THEN 'rule-1' END AS alertname", "CASE WHEN n_nationkey % 3 = 0 THEN 'warning' END AS severity", "CASE WHEN n_nationkey % 5 = 0 THEN 'ops-api' END AS service",
        "timestamp_seconds(unix_seconds(TIMESTAMP '2024-01-01 00:00:00') + n_nationkey * 86400) AS created_at", "timestamp_seconds(unix_seconds(TIMESTAMP '2024-01-01 06:00:00') + n_nationkey * 86400) AS expires_at",
    )
    return A.apply_silences(alerts, silences).select("id", "silenced_by")


_INHIBIT = """WITH f AS (SELECT * FROM alerts WHERE status = 'firing'),
       c AS (SELECT DISTINCT alertname, service FROM f WHERE severity = 'critical'), d AS (SELECT DISTINCT service FROM f WHERE alertname = 'ServiceDown')
       SELECT id, alertname, severity, service FROM f WHERE NOT (severity = 'warning' AND (alertname, service) IN (SELECT (alertname, service) FROM c)) AND NOT (alertname <> 'ServiceDown' AND service IN (SELECT service FROM d))"""


@query(
    "c12_inhibit", "alerts",
    _INHIBIT,
)
def _(alerts):
    return A.inhibit(alerts).select("id", "alertname", "severity", "service")


@query(
    "c12_inhibit_all", "alerts",
    _INHIBIT,
)
def _(alerts):
    return A.inhibit(alerts).select("id", "alertname", "severity", "service")


@query(
    "c13_acknowledged", "alerts operator_actions",
    f"""SELECT id, fingerprint IN (SELECT CAST(target_id AS VARCHAR) FROM operator_actions WHERE action_type = 'dead_letter_acknowledged' AND created_at + INTERVAL 86400 SECOND > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 2 DAY) AS acknowledged FROM alerts""",
)
def _(alerts, actions):
    acks = actions.where("action_type = 'dead_letter_acknowledged'").selectExpr("CAST(target_id AS STRING) AS fingerprint", "created_at AS acked_at")
    return A.with_ack(alerts, acks, "2024-01-29 00:00:00").select("id", "acknowledged")


@query("a15_alert_store_status", "alerts", "SELECT count(*) AS total, epoch_us(max(starts_at)) AS last_ts FROM alerts")
def _(alerts):
    return A.alert_store_status(alerts)


@query("s11_trim_history", "alerts", "SELECT id FROM alerts ORDER BY starts_at DESC, id DESC LIMIT 1000")
def _(alerts):
    return audit.newest_alerts(alerts, 1000).select("id")


@query(
    "p16_route_by_rules", "alerts nation",
    """WITH r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'rule-' || CAST(n_nationkey % 6 AS VARCHAR) END AS a, CASE WHEN n_nationkey % 3 = 0 THEN 'ops-api' END AS s, 'team-' || CAST(n_nationkey % 5 AS VARCHAR) AS channel
                      FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0),
            m AS (SELECT id, list_sort(list(DISTINCT channel)) AS found FROM alerts JOIN r ON (a IS NULL OR a = alertname) AND (s IS NULL OR s = service) GROUP BY id)
       SELECT id, array_to_string(list_concat(CASE severity WHEN 'critical' THEN ['chat', 'webhook'] WHEN 'warning' THEN ['chat'] ELSE ['webhook'] END, coalesce(found, [])), ',') AS channels FROM alerts LEFT JOIN m USING (id)""",
)
def _(alerts, nation):
    named = F.expr("map_filter(map('alertname', CASE WHEN n_nationkey % 2 = 0 THEN concat('rule-', n_nationkey % 6) END, 'service', CASE WHEN n_nationkey % 3 = 0 THEN 'ops-api' END), (k, v) -> v IS NOT NULL)")
    rules = nation.where("n_nationkey % 2 = 0 OR n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("rule_id"), named.alias("match"), F.expr("concat('team-', n_nationkey % 5)").alias("channel"))
    return A.route_by_rules(alerts, rules).select("id", F.array_join("channels", ",").alias("channels"))
