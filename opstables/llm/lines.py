"""Line dedup: range-partitioned hashes, sorted by document and position, streamed for first occurrences.

A line's key is the line without white space at its ends, A-Z lower-cased.  Of a key
with enough code points that several documents hold, only the lines of the smallest
doc_id stay.  Keys travel as 128-bit hashes; texts don't travel to be compared.

Skew: each slice of a batch first drops, for every key, all but the smallest doc_id in
it (no other can be the first), so a line that a third of all documents hold gives one
row a slice, of some thousand documents.  What comes back to a document is a compressed
bitmap of the lines that it keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opstables.llm.common import SPACES, keyed, same_row, slices, stored, utf8

_STRIP = SPACES.encode()
_PLACES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32())])


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The line's key; None if it is too short to be compared."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def _places(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """For each slice of texts and each key in it: a row for each line of the smallest doc_id that has the key."""
    for part in (p for batch in batches for p in slices(batch)):
        first: dict[bytes, int] = {}
        rows: list[tuple[bytes, int, int, int]] = []
        ids, keys = part.column("doc_id").to_pylist(), part.column("text_key").to_pylist()
        for doc, text_key, text in zip(ids, keys, utf8(part.column("text")), strict=True):
            if doc is None:
                continue
            for pos, line in enumerate(text.split(b"\n")):
                if (key := _key(line, min_chars)) is not None:
                    h = xxhash.xxh3_128_digest(key)
                    if first.setdefault(h, doc) > doc:
                        first[h] = doc
                    rows.append((h, doc, text_key, pos))
        rows = [r for r in rows if first[r[0]] == r[1]]
        if rows:
            h, doc, text_key, pos = zip(*rows, strict=True)
            both = np.frombuffer(b"".join(h), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(doc, pa.int64()), pa.array(text_key, pa.int64()), pa.array(pos, pa.int32())], schema=_PLACES)


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, document and position: those of each hash's first document."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id"))
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        owner = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if last and last[:2] == (hi[0], lo[0]):  # the hash began in an earlier batch
            owner[: new[1:].argmax() + 1 if new[1:].any() else len(hi)] = last[2]
        last = (hi[-1], lo[-1], owner[-1])
        yield batch.filter(pa.array(doc == owner)).select(["doc_id", "text_key", "pos"])


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series) -> pd.Series:
    """Sorted line numbers as a compressed bitmap."""

    def pack(at: np.ndarray) -> bytes:
        bits = np.zeros(int(max(at)) + 1, bool)
        bits[np.asarray(at, dtype=np.int64)] = True
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    return positions.map(pack)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_key, keep: a compressed bitmap of the compared lines that the document keeps.

    A document that keeps none of them has no row.  Lines that are too short aren't in the bitmaps.
    """
    rows = keyed(docs).mapInArrow(lambda it: _places(it, min_chars), "hi long, lo long, doc_id long, text_key long, pos int")
    # ranges are cut by a sample: what it is taken from is stored, so that texts are read once
    ordered = stored(rows, "line-places").repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", "doc_id", "pos")
    first = ordered.mapInArrow(_first, "doc_id long, text_key long, pos int")
    return first.groupBy("doc_id", "text_key").agg(F.collect_list("pos").alias("at")).select("doc_id", "text_key", _bitmap("at").alias("keep"))


def _apply(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            n_lines, n_dropped, kept = [], [], []
            for doc, text, keep in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), part.column("keep").to_pylist(), strict=True):
                lines = text.split(b"\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist() if keep else []
                bits += [0] * (len(lines) - len(bits))
                stay = [x for x, bit in zip(lines, bits, strict=False) if bit or doc is None or _key(x, min_chars) is None]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            at = [i for i, name in enumerate(part.schema.names) if name not in ("text", "keep")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in at), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=[*(part.schema.names[i] for i in at), "n_lines", "n_dropped", "kept_text"],
            )


def dedup_lines(docs: DataFrame, min_chars: int = 10, rest: Column | None = None) -> DataFrame:
    """doc_id, text_key, n_lines (before), n_dropped, kept_text: one row for each row of docs.

    A null or empty text is one empty line, which is too short to be compared.  Ties
    don't arise: all lines of the smallest doc_id that holds a key stay, repeated ones too.
    rest: something else of each row to carry along, as a column of that name.
    """
    d = keyed(docs, *([] if rest is None else [rest.alias("rest")]))
    keep = keep_bitmaps(docs, min_chars)
    both = d.join(keep, same_row(d, keep), "left").select(*(d[c] for c in d.columns), keep["keep"])
    carried = both.drop("text", "keep").schema
    out = carried.add("n_lines", "long").add("n_dropped", "long").add("kept_text", "string")
    return both.mapInArrow(lambda it: _apply(it, min_chars), out)
