"""The folder for tables between steps and for stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written inside each open owned() block.
_owners: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only for a local master."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    The shuffle files of the write are freed as it ends, for nothing reads them afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    if _owners:
        _owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """The tables stored inside the block are removed at its end, but for those taken off the list.

    Nothing that still reads them may outlive the block: store a result outside of it, or take its path off.
    """
    _owners.append([])
    try:
        yield _owners[-1]
    finally:
        for path in _owners.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
