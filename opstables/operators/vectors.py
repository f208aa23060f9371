"""Arithmetic between label sets: samples (labels map<string,string>, t, value) that agree in some labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")


def label_set(labels: Column, only: tuple[str, ...] | None = None, without: tuple[str, ...] = ()) -> Column:
    """The labels as an ordered array of entries, which can be a key; null and empty values are as no label, a null map is empty."""
    def kept(e: Column) -> Column:
        wanted = F.coalesce(e["value"] != "", F.lit(False))
        if only is not None:
            return wanted & (e["key"].isin(*only) if only else F.lit(False))
        return wanted & ~e["key"].isin(*without) if without else wanted

    entries = F.coalesce(F.map_entries(labels), F.array().cast("array<struct<key:string,value:string>>"))
    return F.array_sort(F.filter(entries, kept))


def labelled(df: DataFrame, names: list[str], t: str, value: str) -> DataFrame:
    """Samples of a table with a column for each label."""
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return df.select(F.create_map(*pairs).alias("labels"), F.col(t).alias("t"), F.col(value).cast("double").alias("value"))


def total(samples: DataFrame, by: tuple[str, ...] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Sums at each time over the series that agree in the labels by, or in all but without."""
    sums = samples.groupBy("t", label_set(F.col("labels"), by, without).alias("_key")).agg(F.sum("value").alias("value"))
    return sums.select(F.map_from_entries("_key").alias("labels"), "t", "value")


def _combined(op: str, a: Column, b: Column) -> Column:
    """a op b of doubles; a division by zero is an infinity, or NaN for 0 / 0, and never an error."""
    nan = F.lit(float("nan"))
    if op == "/":
        return F.when((b != 0) | F.isnan(b), F.try_divide(a, b)).when((a == 0) | F.isnan(a), nan).when(a.isNotNull() & b.isNotNull(), F.signum(a) * float("inf"))
    if op == "%":
        return F.when(b == 0, nan).otherwise(F.try_mod(a, b))
    if op == "^":
        return F.pow(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _holds(op: str, a: Column, b: Column) -> Column:
    """Comparison of doubles: NaN differs from everything, and is in no order."""
    numbers = ~F.isnan(a) & ~F.isnan(b)
    if op == "!=":
        return (a != b) | ~numbers
    return numbers & {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def compare(samples: DataFrame, op: str, threshold: float) -> DataFrame:
    """The samples whose values compare as op with the threshold."""
    return samples.where(_holds(op, F.col("value"), F.lit(float(threshold))))


def _one(samples: DataFrame, key: Column, side: str) -> DataFrame:
    """A row for each time and key; several series of one key are an error, which is raised when the row is used."""
    rows = samples.select("t", key.alias("_key"), "labels", "value").groupBy("t", "_key").agg(F.count("*").alias("_n"), F.any_value("labels").alias("labels"), F.any_value("value").alias("value"))
    text = F.concat(F.lit(f"several series on the {side} side match "), F.to_json("_key"), F.lit(" at "), F.col("t").cast("string"))
    return rows.withColumn("value", F.when(F.col("_n") > 1, F.raise_error(text).cast("double")).otherwise(F.col("value"))).drop("_n")


def match(left: DataFrame, right: DataFrame, op: str, on: tuple[str, ...] | None = None, ignoring: tuple[str, ...] = (), group: str | None = None, include: tuple[str, ...] = ()) -> DataFrame:
    """Left op right for the samples of one time whose labels agree: those named by on, or all but ignoring.

    group "left" (or "right") lets several series of that side meet one of the other; the result has that side's labels,
    with those of include taken from the other.  Without group the result has the labels that were compared.  A match group with
    several series where one may be fails the query.  A comparison keeps the left values for which it is true.
    Samples without a partner give nothing; null values give null with arithmetic, and nothing with a comparison.
    One shuffle of each side by (t, labels compared): the side that may have one is first reduced to a row each.
    """
    if group not in (None, "left", "right"):
        raise ValueError(f"group is left or right, not {group}")
    if on is not None and ignoring:
        raise ValueError("give on or ignoring, not both")
    key = label_set(F.col("labels"), on, ignoring)

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select("t", key.alias("_key"), "labels", "value") if group == name else _one(df, key, name)
        return rows.select("t", "_key", F.col("labels").alias(f"_{name}_labels"), F.col("value").cast("double").alias(f"_{name}"))

    both = side(left, "left").join(side(right, "right"), ["t", "_key"])
    a, b = F.col("_left"), F.col("_right")
    if group is None:
        shown = F.map_from_entries("_key")
    else:
        many, one = ("_left_labels", "_right_labels") if group == "left" else ("_right_labels", "_left_labels")
        own, other = label_set(F.col(many), without=include), label_set(F.col(one), only=include)
        shown = F.map_from_entries(F.array_sort(F.concat(own, other)) if include else own)
    out = both.where(_holds(op, a, b)) if op in COMPARISONS else both
    return out.select(shown.alias("labels"), "t", (a if op in COMPARISONS else _combined(op, a, b)).alias("value"))
