"""Scalar functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Priority names by rank, and the seconds between callback attempts.
PRIORITIES = {"very_high": 1, "high": 2, "normal": 3, "low": 4, "tide": 5}
CALLBACK_LADDER = (10, 30, 60, 300, 900, 1800, 3600)
RANK_UNIT = 10**13


def _lookup(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def priority_rank(name: Column) -> Column:
    """case doesn't matter; anything unknown is normal."""
    return F.coalesce(_lookup(PRIORITIES)[F.lower(name)], F.lit(3))


def priority_name(rank: Column) -> Column:
    return F.coalesce(_lookup({v: k for k, v in PRIORITIES.items()})[rank], F.lit("normal"))


def score(rank: Column, ms: Column) -> Column:
    """F2"""
    return rank.cast("bigint") * RANK_UNIT + ms.cast("bigint")


def score_rank(s: Column) -> Column:
    return F.floor(s / RANK_UNIT).cast("bigint")


def score_ms(s: Column) -> Column:
    return s % RANK_UNIT


def callback_delay(attempt: Column) -> Column:
    """seconds, for attempts from 1."""
    return F.element_at(F.array(*map(F.lit, CALLBACK_LADDER)), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(CALLBACK_LADDER))).cast("int"))


def durable_delay(attempt: Column) -> Column:
    """seconds."""
    return F.least(F.lit(600.0), 10 * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")


def requeue_delay_ms(attempt: Column) -> Column:
    """F5"""
    return F.least(F.lit(600_000.0), 10_000 * F.pow(F.lit(2.0), attempt)).cast("bigint")


def step_backoff(base: Column, attempt: Column, seed: int = 0) -> Column:
    """seconds, with up to 20 % of jitter."""
    wait = base * F.pow(F.lit(2.0), attempt)
    return F.least(wait + wait * 0.2 * F.rand(seed), F.lit(60.0))


def client_backoff(attempt: Column) -> Column:
    return F.least(0.1 * F.pow(F.lit(2.0), attempt), F.lit(30.0))


def cron_task_id(key: Column) -> Column:
    """F7"""
    return F.concat(F.lit("cron-"), F.left(F.replace(key, F.lit(":"), F.lit("-")), F.lit(60)), F.lit("-"), F.left(F.sha2(key, 256), F.lit(16)))


def cron_key(schedule: Column, at: Column) -> Column:
    """F8"""
    return F.concat(F.lit("cron:"), schedule.cast("string"), F.lit(":"), F.unix_seconds(F.date_trunc("minute", at.cast("timestamp"))).cast("string"))


def epoch_iso(seconds: Column) -> Column:
    """0 is the empty string."""
    return F.when(seconds == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"))


def effective(synced: Column, sync_ts: Column, key: str, local: Column) -> Column:
    """a synced resource if there was a sync and it has any, else the local one."""
    return F.when((sync_ts > 0) & (F.size(synced) > 0), F.coalesce(synced[key], F.lit(0.0))).otherwise(local)


def effective_memory_mb(synced: Column, sync_ts: Column, local_mb: Column) -> Column:
    got = F.when((sync_ts > 0) & (F.size(synced) > 0), F.floor(F.coalesce(synced["memory"], F.lit(0.0)) / 1048576))
    return F.when(got > 0, got).otherwise(local_mb).cast("bigint")


def truncated(error: Column, n: int = 2000) -> Column:
    """F13"""
    return F.left(error, F.lit(n))


def masked(key: Column) -> Column:
    """F14"""
    return F.when(F.coalesce(key, F.lit("")) == "", "").when(F.char_length(key) <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("***"), F.right(key, F.lit(4))))


def filled(template: Column, task_id: Column) -> Column:
    """F15"""
    return F.replace(template, F.lit("{task_id}"), task_id.cast("string"))


def agent_url(host: Column, port: Column) -> Column:
    """F16"""
    return F.concat(F.lit("http://"), host, F.lit(":"), port.cast("string"))


def lock_key(task_id: Column) -> Column:
    return F.concat(F.lit("task_lock:"), task_id.cast("string"))


def nested_resources(prefix: str, *names: str) -> Column:
    """flat columns as a struct; select("struct.*") is the way back."""
    return F.struct(*(F.col(f"{prefix}{n}").alias(n) for n in names))


def utilization(used: Column, most: Column) -> Column:
    """F18"""
    return F.when(most > 0, F.round(used / most, 2)).otherwise(0.0)


def seconds_3dp(seconds: Column) -> Column:
    """F19"""
    return F.round(seconds, 3)
