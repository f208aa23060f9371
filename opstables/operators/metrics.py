"""Counters, histograms, quantiles, rates and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opstables.operators.ordered import pieces
from opstables.operators.ranks import split_rank, split_sum

#: Upper bounds of the duration histogram's buckets, in seconds.
BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)


def count_by(df: DataFrame, *labels: str) -> DataFrame:
    """A counter for each set of labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, labels: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative buckets, +Inf last, with sum and count: one conditional count a bound, one row a label set and bound."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    rows = df.groupBy(*labels).agg(*counts, F.sum(value).alias("sum"), F.count(value).alias("count"))
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("cumulative")))
    return rows.select(*labels, F.inline(F.array(*buckets)), "sum", "count")


def bucket_quantile(hist: DataFrame, q: float, labels: list[str]) -> DataFrame:
    """A10: interpolated inside the bucket that holds the rank; in the last bucket its lower bound."""
    w = Window.partitionBy(*labels).orderBy("le")
    rows = hist.withColumns({"_lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_below": F.coalesce(F.lag("cumulative").over(w), F.lit(0)), "_rank": F.lit(q) * F.col("count")})
    hit = rows.where("cumulative >= _rank AND (_below < _rank OR _below = 0)").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (F.col("_rank") - F.col("_below")) / (F.col("cumulative") - F.col("_below"))
    return hit.select(*labels, F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside).alias("quantile"))


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact order statistics: the element at floor(n * p), by ranks that no single task makes for a whole group."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ranked = split_rank(rows, by, "_v", [], "_i").withColumnRenamed("_i_of", "_n").withColumn("_i", F.col("_i") - 1)

    def at(p: float) -> Column:
        return F.max(F.when(F.col("_i") == F.floor(F.col("_n") * p), F.col("_v")))

    stats = ranked.groupBy(*by).agg(
        F.max("_n").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"),
        F.max(F.when(F.col("_i") == F.expr("_n DIV 2"), F.col("_v"))).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.sum("_v").alias("_s"),
    )
    return stats.withColumn("tps", F.col("n") / (F.col("_s") / 1000)).drop("_s")


def counter_increase(samples: DataFrame, labels: list[str], range_s: int) -> DataFrame:
    """Growth of a counter over the last range_s seconds at each sample (labels, t in seconds, value); a fall is a reset to 0.

    Labels with many samples are cut into pieces of time; each has the last sample before it.  A window is the end of one
    block of range_s seconds and the beginning of the next: running sums from both ends of the blocks, one of each a sample, so
    that the work doesn't grow with the samples in a window.  Nothing is subtracted, and no task has more than a block.
    """
    held = pieces(samples.select(*labels, "t", "value"), labels, "t").last_before(["t"], {"_before": F.struct("value")})
    before = F.col("_before.value")
    inc = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    rows = held.plain().select(*labels, "t", inc.alias("_inc"), F.floor(F.col("t") / range_s).alias("_piece"))
    block = Window.partitionBy(*labels, "_piece")

    def summed(order: Column) -> Column:
        return F.sum("_inc").over(block.orderBy(order).rangeBetween(Window.unboundedPreceding, 0))

    rows = rows.select(*labels, "t", "_piece", summed(F.col("t").asc()).alias("_head"), summed(F.col("t").desc()).alias("_tail"))
    # a sample's tail counts in the next block, up to where its time leaves the window
    own = F.struct("t", "_piece", "_head", F.lit(None).cast("double").alias("_tail"), F.lit(1).alias("_side"))
    later = F.struct((F.col("t") + (range_s - 1)).alias("t"), (F.col("_piece") + 1).alias("_piece"), F.lit(None).cast("double").alias("_head"), "_tail", F.lit(0).alias("_side"))
    both = rows.select(*labels, F.inline(F.array(own, later))).where("_side = 1 OR t IS NOT NULL")
    nearest = F.last("_tail", ignorenulls=True).over(block.orderBy(F.col("t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    increase = F.coalesce(F.col("_head") + F.col("_rest"), "_head", "_rest")
    return both.withColumn("_rest", nearest).where("_side = 1").select(*labels, "t", increase.alias("increase"))


def counter_rate(samples: DataFrame, labels: list[str], range_s: int) -> DataFrame:
    return counter_increase(samples, labels, range_s).select(*labels, "t", (F.col("increase") / range_s).alias("rate"))


def success_ratio(df: DataFrame, by: list[str], status: str = "status", failure_values: tuple[str, ...] = ("failed",)) -> DataFrame:
    """A13"""
    bad = F.count_if(F.col(status).isin(*failure_values))
    return df.groupBy(*by).agg(F.count("*").alias("n"), ((F.count("*") - bad) / F.count("*")).alias("success"), (bad / F.count("*")).alias("failure"))


def ratio_ignoring(df: DataFrame, label: str, numerator: str, by: list[str]) -> DataFrame:
    """For each label set the share of rows with the numerator's label, of all rows that agree in the other labels: two counts, one pass."""
    return df.groupBy(*by).agg((F.count_if(F.col(label) == numerator) / F.count("*")).alias("ratio"))


def throughput(events: DataFrame, time: str, interval: str, by: list[str]) -> DataFrame:
    """Events per tumbling window."""
    win = F.window(F.col(time).cast("timestamp"), interval)
    return events.groupBy(win, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def depth_trend(events: DataFrame, by: list[str]) -> DataFrame:
    """A queue's depth after each event: enqueued less started, never below a running sum of both."""
    step = F.when(F.col("event") == "enqueue", 1).when(F.col("event") == "start", -1).otherwise(0)
    rows = events.select(*by, "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("_t"), step.cast("bigint").alias("_step"))
    return split_sum(rows, by, "_t", ["id"], "_step", "depth").select(*by, "id", "depth")


def gauge_max(samples: DataFrame, value: str, by: list[str], threshold: float) -> DataFrame:
    """A20"""
    return samples.groupBy(*by).agg(F.max(value).alias("max_value")).withColumn("breached", F.col("max_value") > threshold)
