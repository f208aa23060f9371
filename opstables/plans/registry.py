"""Registration of queries: an operator applied to whole tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstables.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds, which all engines print alike."""
    return df.select(*(F.unix_micros(F.col(c).cast("timestamp")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))


def query(name: str, views: str, sql: str | None = None) -> Callable:
    """The decorated function gets the views (named, by spaces) as DataFrames; sql is for DuckDB, over the same views."""
    names = tuple(views.split())

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(*(fixtures.view(spark, sf_dir, v) for v in names)))
        if sql is not None:
            ORACLES[name] = fixtures.with_views(names, sql)
        return f

    return register
