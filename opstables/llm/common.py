"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opstables.sources.scratch import stored as stored  # the operators take it from here

#: White space in the sense of all operators here: space and \x09 to \x0D (what bytes.split() splits at).
SPACES = " \t\n\x0b\x0c\r"
#: Text that one step of a Python worker holds at a time, in bytes (one longer text is taken alone).
SLICE_BYTES = 4_000_000
#: Largest table, in bytes, that an operator broadcasts; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text without nulls, text_key (64-bit hash: with doc_id it names a row's content), and the columns named."""
    return docs.select("doc_id", text_col().alias("text"), F.xxhash64(text_col()).alias("text_key"), *more)


def carried(docs: DataFrame) -> Column:
    """All columns of a row but its text, as one struct: their names can't clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.col("text").isNull().alias("text"))


def restored(text: Column, docs: DataFrame, row: str) -> list[Column]:
    """The columns of docs out of such a struct, with a new text and, if docs has one, its n_chars; null texts stay null."""
    new = {"text": F.when(~F.col(f"{row}.text"), text).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(f"{row}.text"), F.col(f"{row}.n_chars")).otherwise(F.char_length(text).cast(kind)).alias("n_chars")
    return [new.get(c, F.col(f"{row}.`{c}`")) for c in docs.columns]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def fits_broadcast(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_BYTES


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most `most` bytes (a longer text is a run of its own)."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def list_array(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
