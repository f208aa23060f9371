"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and get the fractional rank
(2 * rank - 1) / (2 * rows of the source).  Sorted by it, any run of rows holds all
sources in proportion; cut into equal runs, every shard matches the mixture, and the
shards' row counts differ by at most one.

No rank is taken over a whole source or the whole table in one task: hash prefixes
split a source, ranges of the fractional rank split the table, and the counts of these
pieces (small, pre-aggregated) give each piece's first rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opstables.llm.common import stored, text_col

#: Pieces of a source and of the table; each is ranked by one task.
PIECES = 1024


def interleaved_shards(docs: DataFrame, shards: int = 16, seed: int = 42, source: str = "source") -> DataFrame:
    """doc_id, text_size (UTF-8 bytes + 1), text_crc32, shard, slot: one row for each row of docs.

    Null sources form a source of their own; rows without doc_id are shuffled as the id "".
    Equal fractional ranks are ordered by hash, then source, doc_id and content, so repeated
    rows are interchangeable.  slot counts from 0 within a shard.
    """
    text = F.encode(text_col(), "UTF-8")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"),
        F.col(source).isNull().alias("no_src"),
        (F.length(text) + 1).cast("long").alias("text_size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    ).withColumn("piece", F.expr(f"CAST(conv(substr(h, 1, 8), 16, 10) AS BIGINT) DIV {2**32 // PIECES}"))
    per_piece = rows.groupBy("src", "no_src", "piece").agg(F.count("*").alias("n"))
    all_before = Window.partitionBy("src", "no_src").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_piece.select(
        "src", "no_src", "piece", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("src", "no_src")).alias("total")
    )
    in_piece = Window.partitionBy("src", "no_src", "piece").orderBy("h", "doc_id", "text_crc32", "text_size")
    ranked = rows.withColumn("r", F.row_number().over(in_piece)).join(starts, ["src", "no_src", "piece"])
    at = ((2 * (F.col("before") + F.col("r")) - 1) / (2 * F.col("total"))).cast("double")
    placed = stored(
        ranked.select("doc_id", "src", "no_src", "text_size", "text_crc32", "h", at.alias("at")).withColumn("span", F.least(F.floor(F.col("at") * PIECES), F.lit(PIECES - 1)).cast("long")),
        "shard-ranks",
    )
    counts = {r["span"]: r["n"] for r in placed.groupBy("span").agg(F.count("*").alias("n")).collect()}  # at most PIECES rows
    offsets, n = [], 0
    for s in range(PIECES):
        offsets.append(n)
        n += counts.get(s, 0)
    in_span = Window.partitionBy("span").orderBy("at", "h", "src", "no_src", "doc_id", "text_crc32", "text_size")
    position = F.row_number().over(in_span) - 1 + F.element_at(F.array(*map(F.lit, offsets)), (F.col("span") + 1).cast("int")).cast("long")
    first = F.expr(f"(shard * {n}L + {shards - 1}) DIV {shards}")  # of shard s: the least position p with p * shards / n >= s
    return (
        placed.withColumn("position", position)
        .withColumn("shard", F.expr(f"CAST(position * {shards} DIV {max(n, 1)} AS INT)"))
        .select("doc_id", "text_size", "text_crc32", "shard", (F.col("position") - first).alias("slot"))
    )
