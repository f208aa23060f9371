"""Validation reports and verdicts on requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that need an admin and a reason; hosts and address ranges that URLs must not name.
HIGH_RISK = (
    "force_replay_on_active_lease", "force_replay_on_running_task", "force_replay_without_reason",
    "force_acknowledge_dead_letter_without_review", "force_lease_eviction",
)
BLOCKED_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")
PRIVATE_HOST = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.)"


def _reasons(*parts: Column) -> Column:
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) == 0, F.array(F.lit("allowed"))).otherwise(found)


def _no_reason(c: str = "reason") -> Column:
    return F.coalesce(c, F.lit("")) == ""


def validate(requests: DataFrame) -> DataFrame:
    """All violations of a request (empty: valid)."""
    rules = {
        "task_type must have 1 to 128 characters": ~F.char_length(F.coalesce("task_type", F.lit(""))).between(1, 128),
        "timeout_seconds must be 1 to 86400": ~F.col("timeout_seconds").between(1, 86400),
        "max_retries must be 0 to 20": ~F.col("max_retries").between(0, 20),
        "scheduled_at excludes delay_seconds": F.col("scheduled_at").isNotNull() & F.col("delay_seconds").isNotNull(),
        "artifact_sha256 must have 64 characters": (F.col("artifact_url") != "") & (F.col("artifact_sha256") != "") & (F.char_length("artifact_sha256") != 64),
        "artifact needs an entrypoint": (F.col("artifact_url") != "") & (F.coalesce("entrypoint", F.lit("")) == ""),
    }
    return requests.withColumn("violations", F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules.items()))))


def url_verdict(url: Column, allow_private: bool = False) -> Column:
    """P10"""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, r"^[^/]*//(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    verdict = F.when(~F.coalesce(scheme, F.lit("")).isin("http", "https"), "unsupported scheme").when(host == "", "no hostname").when(host.isin(*BLOCKED_HOSTS), "blocked hostname")
    return (verdict if allow_private else verdict.when(host.rlike(PRIVATE_HOST), "private address")).otherwise("ok")


def govern(df: DataFrame, high_risk: tuple[str, ...] = HIGH_RISK) -> DataFrame:
    """P11"""
    risky = F.col("operation").isin(*high_risk)
    roles = F.when(risky, F.array(F.lit("admin"))).otherwise(F.array(F.lit("operator"), F.lit("admin")))
    return df.withColumns({"high_risk": risky, "strong_audit": risky, "allowed_roles": roles})


def force_verdict(requests: DataFrame) -> DataFrame:
    """Role first, then the reason of a high-risk operation."""
    rows = govern(requests)
    error = F.when(~F.array_contains("allowed_roles", F.col("actor_role")), "role_too_low").when(F.col("high_risk") & _no_reason(), "reason_missing")
    return rows.withColumns({"error": error, "ok": error.isNull(), "audit_action": F.when(error.isNull(), F.concat(F.lit("force_"), F.col("operation")))})


def callback_replay_verdict(requests: DataFrame, outbox: DataFrame) -> DataFrame:
    """P13"""
    rows = requests.join(outbox.select(F.col("id").alias("outbox_id"), "delivery_status"), "outbox_id", "left")
    status, admin = F.col("delivery_status"), F.col("actor_role") == "admin"
    missing, delivered = status.isNull(), F.coalesce(status == "delivered", F.lit(False))
    reasons = _reasons(
        F.when(_no_reason(), "reason_missing"),
        F.when(status == "pending", "already_pending"),
        F.when(delivered & admin, "delivered_admin_override"),
        F.when(delivered & ~admin, "delivered_needs_admin"),
    )
    allowed = ~missing & ~_no_reason() & (status != "pending") & (~delivered | admin)
    shown = F.when(missing, F.array(F.lit("callback_unknown"))).otherwise(reasons)
    return rows.select("request_id", "outbox_id", F.coalesce(allowed, F.lit(False)).alias("allowed"), shown.alias("reasons"))


def replay_verdict(requests: DataFrame, leases: DataFrame, recent: DataFrame, most: int = 3) -> DataFrame:
    """Recent is (task_id, n) of replays in the window.  An admin's override of a lease allows even without a reason; the rate comes last."""
    rows = requests.join(leases.select("task_id", F.lit(True).alias("_l")), "task_id", "left").join(recent, "task_id", "left")
    lease, admin, n = F.col("_l").isNotNull(), F.col("actor_role") == "admin", F.coalesce("n", F.lit(0))
    over = n >= most
    allowed = F.when(over, False).when(lease, admin).otherwise(~_no_reason())
    reasons = _reasons(
        F.when(_no_reason(), "reason_missing"),
        F.when(lease, "lease_active"),
        F.when(lease & admin, "lease_admin_override"),
        F.when(over, "rate_exceeded"),
    )
    return rows.select("request_id", "task_id", allowed.alias("allowed"), reasons.alias("reasons"))
