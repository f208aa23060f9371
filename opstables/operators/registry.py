"""Registries: layered lookups, merges, keys, placement, usage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opstables.operators.audit import top_per_key
from opstables.operators.ranks import if_small


def first_available(keys: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Each key's row from the first source that has it, with the source's number."""
    ranked = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b), ranked).join(keys.select(key).distinct(), key, "left_semi")
    return top_per_key(union, [key], [F.col("source")], 1, "_r").drop("_r")


def merge_record(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Fields of the patch that aren't null override; the key stays."""
    p = patch.select(key, *(F.col(c).alias(f"_p_{c}") for c in patch.columns if c != key))
    shown = [F.coalesce(f"_p_{c}", c).alias(c) if f"_p_{c}" in p.columns else F.col(c) for c in base.columns]
    return base.join(p, key, "left").select(*shown)


def resolve_keys(requests: DataFrame, api_keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """The tenant of each key (by hash) if it is active and, where a tenant is hinted, the same."""
    hashed = requests.withColumn("key_hash", F.sha2("api_key", 256)).join(api_keys.withColumnRenamed("tenant_id", "owner"), "key_hash", "left")
    rows = hashed.join(if_small(tenants.select(F.col("tenant_id").alias("owner"), "status")), "owner", "left")
    verdict = (
        F.when(F.col("owner").isNull(), "unknown key").when(F.col("tenant_hint").isNotNull() & (F.col("tenant_hint") != F.col("owner")), "tenant mismatch")
        .when(F.coalesce("status", F.lit("")) != "active", "tenant not active").otherwise("ok")
    )
    return rows.select("request_id", F.when(verdict == "ok", F.col("owner")).alias("tenant_id"), verdict.alias("verdict"))


def select_cluster(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    """C14: for each request (request_id, gpus, tenant_id and, if it has them, capability) the active, visible cluster with the most free GPUs, then CPUs.

    A request without a tenant sees all clusters, one with a tenant its own and the public ones; one that names a
    capability sees the clusters that list it.  If the cluster with the most GPUs has too few, all have: so the best one
    of each tenant and capability is enough, a partial aggregate that requests meet by equi-joins.
    """
    can = F.col("capabilities") if "capabilities" in clusters.columns else F.array().cast("array<string>")
    best = F.max(F.struct("available_gpus", "available_cpus", "neg_id"))  # the least number on ties
    listed = clusters.where("status = 'active'").select(
        F.coalesce("tenant_id", F.lit("")).alias("tenant"), "available_gpus", "available_cpus", (-F.col("cluster_id")).alias("neg_id"),
        F.explode(F.array_union(F.array(F.lit("")), F.coalesce(can, F.array().cast("array<string>")))).alias("cap"),
    )
    by_tenant = listed.groupBy("tenant", "cap").agg(best.alias("own"))
    public = by_tenant.where("tenant = ''").select("cap", F.col("own").alias("public"))
    everyone = listed.groupBy("cap").agg(best.alias("any"))
    cap = F.coalesce("capability", F.lit("")) if "capability" in requests.columns else F.lit("")
    rows = requests.select("request_id", F.coalesce("gpus", F.lit(0)).alias("gpus"), F.coalesce("tenant_id", F.lit("")).alias("tenant"), cap.alias("cap"))
    rows = rows.join(if_small(by_tenant.where("tenant <> ''")), ["tenant", "cap"], "left").join(if_small(public), "cap", "left").join(if_small(everyone), "cap", "left")
    chosen = F.when(F.col("tenant") == "", F.col("any")).otherwise(F.greatest("own", "public"))
    fits = (F.col("gpus") <= 0) | (chosen["available_gpus"] >= F.col("gpus"))
    return rows.select("request_id", F.when(fits, -chosen["neg_id"]).alias("cluster_id"))


def with_tenant(fires: DataFrame, schedules: DataFrame) -> DataFrame:
    """C15"""
    return fires.join(schedules.select("schedule_id", "tenant_id"), "schedule_id", "left")


def tenant_usage(usage: DataFrame, tenants: DataFrame) -> DataFrame:
    """Usage (tenant_id, gpus, actors: a row a task) against quotas; 0 is unlimited."""
    used = usage.groupBy("tenant_id").agg(F.sum("gpus").alias("gpu_count"), F.count("*").alias("task_count"), F.sum("actors").alias("actor_count"))
    rows = tenants.join(used, "tenant_id", "left").na.fill(0, ["gpu_count", "task_count", "actor_count"])
    over = [(F.col(q) > 0) & (F.col(n) > F.col(q)) for n, q in (("gpu_count", "max_gpus"), ("task_count", "max_tasks"), ("actor_count", "max_actors"))]
    return rows.select("tenant_id", "gpu_count", "task_count", "actor_count", reduce(lambda a, b: a | b, over).alias("over_quota"))


def observed_resources(nodes: DataFrame) -> DataFrame:
    """Sums over each cluster's joined nodes."""
    return nodes.where("state = 'joined'").groupBy("cluster_id").agg(F.sum("gpus").alias("total_gpus"), F.sum("cpus").alias("available_cpus"), F.count("*").alias("nodes"))
