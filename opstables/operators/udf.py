"""User code over rows in Python workers, Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Worker:
    """Subclass and define call; the others are optional.  One instance serves a partition."""

    def pre_process(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch

    def call(self, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def post_process(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch


def apply_worker(df: DataFrame, worker: Callable[[], Worker], schema: str) -> DataFrame:
    """Every batch through pre_process, call and post_process."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = worker()
        for b in batches:
            yield w.post_process(w.call(w.pre_process(b)))

    return df.mapInPandas(run, schema)


def dispatch_by_capability(df: DataFrame, functions: dict[str, Callable[[pd.DataFrame], pd.DataFrame]], schema: str, capability: str = "capability") -> DataFrame:
    """Each row to its capability's function (pandas to pandas, of the schema); rows of unknown capabilities get an error instead.

    No shuffle: a batch is split by capability where it is.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, part in b.groupby(capability, dropna=False):
                if name in functions:
                    yield functions[name](part).assign(error=None)[[*names, "error"]]
                else:
                    yield part.reindex(columns=names).assign(error=f"unknown capability {name}")

    return df.mapInPandas(run, f"{schema}, error string")


def assert_output(df: DataFrame, expected: dict[str, str], allow_extra: bool = True) -> DataFrame:
    """D3: raises unless the columns are there with their types (and, if asked, no others)."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in expected.items() if have.get(c) != t]
    extra = [] if allow_extra else [c for c in have if c not in expected]
    if wrong or extra:
        raise ValueError("; ".join([*wrong, *(f"{c}: not expected" for c in extra)]))
    return df


def observe_calls(df: DataFrame, by: dict[str, Any], name: str = "calls") -> tuple[DataFrame, Observation]:
    """Df, and an observation that holds, after an action, the counts of rows for which each condition holds."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("calls"), *(F.count_if(c).alias(n) for n, c in by.items())), seen
