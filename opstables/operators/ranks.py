"""Ranks and running sums within keys of which a few hold most rows, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64
#: The most rows that an operator broadcasts; a larger table is joined by a shuffle.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows (they are counted, up to the bound)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _pieces(df: DataFrame, keys: list[str], value: str, pieces: int) -> DataFrame:
    """df with `_piece`: approximate quantiles cut each key's values into pieces; equal values are in one piece."""
    cuts = df.groupBy(*keys).agg(F.approx_percentile(value, [i / pieces for i in range(1, pieces)], 1000).alias("_cuts"))
    return df.join(cuts, keys).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def split_rank(df: DataFrame, keys: list[str], value: str, ties: list[str], name: str, pieces: int = PIECES) -> DataFrame:
    """df with the 1-based rank of each row within its keys by (value, ties), and `{name}_of`, the rows of its keys.

    No task ranks a whole key: each piece of its values is ranked by itself, and the counts of the pieces before it (a
    few numbers a key) are added.  Rows of equal values are ranked by one task.
    """
    rows = _pieces(df, keys, value, pieces)
    counts = rows.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_of"))
    place: Column = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(value, *ties))
    ranked = rows.withColumn("_r", place).join(starts, [*keys, "_piece"])
    return ranked.withColumn(name, F.col("_r") + F.col("_before")).drop("_piece", "_r", "_before")


def split_sum(df: DataFrame, keys: list[str], value: str, ties: list[str], amount: str, name: str, pieces: int = PIECES) -> DataFrame:
    """df with the sum of amount over the rows of its keys up to each row, by (value, ties); in pieces, as split_rank."""
    rows = _pieces(df, keys, value, pieces)
    sums = rows.groupBy(*keys, "_piece").agg(F.sum(amount).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.sum(amount).over(Window.partitionBy(*keys, "_piece").orderBy(value, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(starts, [*keys, "_piece"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_piece", "_own", "_before")
