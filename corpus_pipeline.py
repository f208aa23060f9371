"""Documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept and returns the columns of documents; the
last returns where each piece of a document is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opstables.llm import classifier, lines, packing, secrets, simhash
from opstables.llm.common import carried, documents, fits_broadcast, restored, stored, text_col
from opstables.llm.queries import QUALITY_THRESHOLD, quality_model
from opstables.sources.scratch import owned


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    scored = classifier.score(docs, quality_model(spark, docs, sf_dir), rest=F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return scored.where(F.col("score") >= QUALITY_THRESHOLD).select("rest.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that a document with a smaller doc_id holds, too; null texts stay null."""
    found = lines.dedup_lines(docs, rest=carried(docs))
    return found.select(*restored(F.col("kept_text"), docs, "rest"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies.

    Of rows that repeat that doc_id with near copies of its text, the one with the least hash of the
    text stays; of rows that repeat the text, too, the least by their other columns.  Rows that repeat
    a doc_id with an unrelated text stay, and so do rows without doc_id.
    """
    groups = simhash.near_groups(docs, simhash.NEAR_COPIES).where("doc_id IS NOT NULL")
    texts = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.min("is_first").alias("is_first"))
    marked = stored(texts.where("n > 1 OR NOT is_first").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "is_first"), "near-copies")
    small = fits_broadcast(marked.count(), 24)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64(text_col()).alias("own_key"))
    joined = rows.join(F.broadcast(marked) if small else marked, (F.col("own_id") == F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    stay = joined.where("is_first IS NULL").select("row")
    if not marked.where("is_first").isEmpty():
        others = F.to_json(F.struct(*(F.col(f"row.`{c}`") for c in docs.columns if c != "text")))
        stay = stay.unionByName(joined.where("is_first").groupBy("own_id", "own_key").agg(F.min_by("row", others).alias("row")).select("row"))
    return stay.select("row.*")


def without_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets that look live and that one owner holds; copied examples stay."""
    return secrets.redact_live(docs, secrets.find_secrets(docs, owner=docs["source"], repo=F.concat_ws("/", docs["source"], docs["lang"])))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, size, source, bin, start."""
    return packing.pack(docs).drop("text_key")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("secret scans", without_live_secrets),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's own tables, and its predecessor's, are removed once its result is stored."""
    docs = documents(spark, sf_dir)
    with owned(spark) as before:
        for _, stage in STAGES[:-1]:
            with owned(spark) as made:
                docs = stored(stage(spark, docs, sf_dir), "stage")
                before.append(made.pop())
        # packing is lazy and reads the last of them: that one stays
        docs = STAGES[-1][1](spark, docs, sf_dir)
        before.pop()
    return docs
