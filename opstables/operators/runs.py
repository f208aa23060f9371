"""Folds over each key's rows in order, in memory that doesn't grow with a key's history."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: (state, order values and fields of a row) -> (state, rows).
Step = Callable[..., tuple[Any, list[tuple]]]


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], fields: list[str], start: Any, step: Step, schema: str, end: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """The keys and the rows of `schema` that step gives over each key's rows in order; end gives more after the last.

    Rows are dealt by key and sorted (which spills); a task streams them and holds the state of one key and
    one Arrow batch, so a key that holds most of the rows takes one task long, but no memory.
    """
    inputs = [*keys, *order, *fields]
    rows = df.select(*inputs).repartition(*keys).sortWithinPartitions(*keys, *order)
    given = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    wanted, n = to_arrow_schema(given), len(keys)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in wanted]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: Any = start
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    if key is not None and end is not None:
                        out += [(*key, *r) for r in end(state)]
                    key, state = row[:n], start
                state, found = step(state, *row[n:])
                out += [(*key, *r) for r in found]
            yield batch_of(out)
        if key is not None and end is not None:
            yield batch_of([(*key, *r) for r in end(state)])

    return rows.mapInArrow(run, given)
