"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A bin holds at most one piece of each source and of each cluster of duplicates; it carries
bitmaps of both.  Bins stand in the order of their free room.  For a piece, the search starts
at the first bin with room for it and goes on to the next ones until a bin has no conflict: that
is the tightest compatible bin.  Blocks of bins know the bits that all their bins share, so a
block that conflicts throughout is skipped at once (most are, for a hot source or cluster).

Rows are dealt to pools of some POOL_ROWS by a hash of the row and its place in the input, so
that even rows that repeat each other are spread; a pool is packed by one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import keyed, text_col
from opstables.llm.quality_rules import words

POOL_ROWS = 1024
CAPACITY = 2048
_BLOCK = 64


class Bins:
    """Bins in the order of (free room, number), in blocks with the AND of their bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = []
        self.shared: list[tuple[int, int]] = []

    def _share(self, b: int) -> None:
        self.shared[b] = (reduce(and_, (self.sources[n] for _, n in self.blocks[b])), reduce(and_, (self.clusters[n] for _, n in self.blocks[b])))

    def take(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Puts a piece (source and cluster are single bits, cluster may be 0) into the tightest compatible bin, or a new one: its number, where the piece starts."""
        b = bisect_left(self.blocks, size, key=lambda block: block[-1][0])
        for b in range(b, len(self.blocks)):
            if self.shared[b][0] & source or self.shared[b][1] & cluster:
                continue
            block = self.blocks[b]
            for i in range(bisect_left(block, (size, -1)), len(block)):
                room, n = block[i]
                if not (self.sources[n] & source or self.clusters[n] & cluster):
                    del block[i]
                    if block:
                        self._share(b)
                    else:
                        del self.blocks[b], self.shared[b]
                    return self._put(n, room, size, source, cluster)
        self.sources.append(0)
        self.clusters.append(0)
        return self._put(len(self.sources) - 1, self.capacity, size, source, cluster)

    def _put(self, n: int, room: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self.sources[n] |= source
        self.clusters[n] |= cluster
        entry = (room - size, n)
        if not self.blocks:
            self.blocks, self.shared = [[]], [(0, 0)]
        b = min(bisect_left(self.blocks, entry, key=lambda block: block[-1] if block else entry), len(self.blocks) - 1)
        insort(self.blocks[b], entry)
        if len(self.blocks[b]) > 2 * _BLOCK:
            self.blocks[b : b + 1] = [self.blocks[b][:_BLOCK], self.blocks[b][_BLOCK:]]
            self.shared[b : b + 1] = [(0, 0), (0, 0)]
            self._share(b + 1)
        self._share(b)
        return n, self.capacity - room


def _pack(capacity: int, table: pa.Table) -> pa.Table:
    """The pieces of a pool, largest first; ties by cluster, doc_id (null last), text_key, piece."""
    rows = table.to_pydict()
    n = table.num_rows
    order = sorted(range(n), key=lambda i: (-rows["size"][i], rows["cluster"][i], rows["doc_id"][i] is None, rows["doc_id"][i] or 0, rows["text_key"][i], rows["piece"][i]))
    times: dict[str, int] = {}
    for c in rows["cluster"]:
        times[c] = times.get(c, 0) + 1
    source_bits: dict[str, int] = {}
    cluster_bits: dict[str, int] = {}
    bins, at = Bins(capacity), [(0, 0)] * n
    for i in order:
        source, cluster = rows["source"][i], rows["cluster"][i]
        bit = 1 << source_bits.setdefault(source, len(source_bits))
        copies = 1 << cluster_bits.setdefault(cluster, len(cluster_bits)) if times[cluster] > 1 else 0
        at[i] = bins.take(rows["size"][i], bit, copies)
    pool = rows["pool"][0] if n else 0
    return table.drop_columns(["pool", "cluster"]).append_column("bin", pa.array([pool << 32 | b for b, _ in at], pa.int64())).append_column("start", pa.array([s for _, s in at], pa.int64()))


def pack(docs: DataFrame, capacity: int = CAPACITY, source: str = "source", cluster: Column | None = None, pool_rows: int = POOL_ROWS) -> DataFrame:
    """doc_id, text_key, piece, size, source, bin, start: where each piece of each row of docs stands.

    A text's length is its words and one for its end, so empty and null texts take one place.  A
    text longer than the capacity is cut into pieces, all but its last of full size.  Null sources
    count as one source "".  cluster: the column that duplicates share, by default the text's
    hash; null means no duplicates.  Repeated rows are packed each, into different bins.  Pools, and
    so bins, depend on how the input is partitioned.
    """
    own = F.coalesce(cluster.cast("string"), F.concat(F.lit("-"), F.col("doc_id").cast("string")), F.lit("")) if cluster is not None else F.xxhash64(text_col()).cast("string")
    named = docs.select("doc_id", "text", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), own.alias("cluster"))
    pools = max(1, -(-docs.count() // pool_rows))
    sized = keyed(named, "source", "cluster").select("doc_id", "text_key", "source", "cluster", (F.size(words(F.col("text"))) + 1).cast("long").alias("length"), F.monotonically_increasing_id().alias("place"))
    last = F.expr(f"(length - 1) DIV {capacity}")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "text_key", "piece", F.least(F.lit(capacity), F.col("length") - F.col("piece") * capacity).cast("long").alias("size"), "source", "cluster",
        F.pmod(F.xxhash64("doc_id", "text_key", "place"), F.lit(pools)).alias("pool"),
    )
    return pieces.groupBy("pool").applyInArrow(lambda t: _pack(capacity, t), "doc_id long, text_key long, piece long, size long, source string, bin long, start long")
