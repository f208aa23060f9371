"""Exact dedup by progressive refinement: length, then the hash of a prefix, then the full hash.

Only texts whose length and prefix hash several rows share are hashed whole, as long as the
surviving keys fit a broadcast (their size is checked); beyond that all texts are hashed where they
are read, and the survivors are found by a shuffled join.  The shuffles carry lengths and hashes,
never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opstables.llm.common import fits_broadcast, stored, text_col

PREFIX_CHARS = 64


def duplicate_groups(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs, by equality of whole texts.

    Null counts as the empty text.  The row with the largest doc_id of a group stays
    (rows without doc_id rank lowest; a group of those alone keeps null as its keep_id, and all of them).
    Rows that repeat that doc_id with that text are kept alike.  text_sha256 is null for rows
    that no refinement needed to hash, unless digests is set.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_col().alias("text")).withColumns(
        {"len": F.octet_length("text").cast("long"), "prefix": F.xxhash64(F.substring("text", 1, PREFIX_CHARS))}
    )
    by_length = rows.groupBy("len", "prefix").agg(F.count("*").alias("n"))  # partial sums: a hot length or prefix is a row a task
    lengths = by_length.groupBy("len").agg(F.sum("n").alias("len_n")).where("len_n > 1").select("len")
    survivors = stored(by_length.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix", F.lit(True).alias("again")), "exact-keys")
    sha = F.sha2("text", 256)
    if fits_broadcast(survivors.count(), 32):
        marked = rows.join(F.broadcast(survivors), ["len", "prefix"], "left")
        hashed = marked.select("doc_id", F.when(F.col("again"), sha).alias("full"), (sha if digests else F.when(F.col("again"), sha)).alias("text_sha256"))
    else:  # hashing costs less than bringing texts to their keys
        marked = rows.select("doc_id", "len", "prefix", sha.alias("sha")).join(survivors, ["len", "prefix"], "left")
        hashed = marked.select("doc_id", F.when(F.col("again"), F.col("sha")).alias("full"), (F.col("sha") if digests else F.when(F.col("again"), F.col("sha"))).alias("text_sha256"))
    groups = stored(
        hashed.where("full IS NOT NULL").groupBy("full").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"),
        "exact-groups",
    )
    # rows that were not hashed get a key of their own, so that they don't meet in one task
    alone = F.coalesce("full", F.concat(F.lit("-"), F.coalesce("doc_id", F.floor(F.rand(7) * 2**40).cast("long")).cast("string")))
    small = fits_broadcast(groups.count(), 120)
    out = hashed.withColumn("full", alone).join(F.broadcast(groups) if small else groups, "full", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256"
    )
