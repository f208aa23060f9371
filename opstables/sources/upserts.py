"""Keyed tables that streams update: immutable parts, and a log of commits of which the last one names the parts that count.

A commit adds one part with the rows that changed; a read takes each key's latest row.  A batch that
is run again finds its number in the log and changes nothing.  Parts are joined to one every COMPACT commits, so a read sees few.
One writer at a time; readers keep to the commit that they began with.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts after which they are joined to one.
COMPACT = 10


class KeyedTable:
    """Rows by key.  order: columns of which the largest values win (rows may come in any order); without them the later commit wins."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order

    def _files(self, path: str) -> tuple[Any, Any]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def last(self) -> dict[str, Any]:
        """The last commit: version, schema, parts, and the last batch of each writer."""
        files, log = self._files(f"{self.path}/_log")
        names = sorted(s.getPath().getName() for s in files.listStatus(log)) if files.exists(log) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith("_")]
        if not names:
            return {"version": 0, "schema": None, "parts": [], "batches": {}}
        stream = files.open(self._files(f"{self.path}/_log/{names[-1]}")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, commit: dict[str, Any]) -> None:
        """Makes a commit the last one, in one step; an error if another writer was faster."""
        files, target = self._files(f"{self.path}/_log/{commit['version']:012d}.json")
        _, draft = self._files(f"{self.path}/_log/_{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(json.dumps(commit).encode())
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"version {commit['version']} of {self.path} is there already")

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def has(self, batch: int, writer: str = "main") -> bool:
        return self.last()["batches"].get(writer, -1) >= batch

    def read(self, schema: str | StructType | None = None) -> DataFrame:
        """Each key's row; schema tells the columns of a table that has none yet."""
        commit = self.last()
        if not commit["parts"]:
            if schema is None:
                raise ValueError(f"{self.path} has no rows yet, and no schema is given")
            return self.spark.createDataFrame([], schema)
        known = StructType.fromJson(commit["schema"])
        rows = self.spark.read.schema(known.add("_version", "long")).parquet(*(f"{self.path}/{p}" for p in commit["parts"]))
        if len(commit["parts"]) == 1:
            return rows.drop("_version")
        # a part has a key once: what a task reads of them needn't be sorted before the shuffle
        return self._latest(rows.repartition(*self.keys), [*self.order, "_version"]).drop("_version")

    def _latest(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row a key: the last by order."""
        rest = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
        return rows.groupBy(*self.keys).agg(F.max_by(rest, F.struct(*order)).alias("_row")).select("_row.*")

    def merge(self, rows: DataFrame, batch: int | None = None, writer: str = "main") -> bool:
        """Adds rows and replaces those of equal keys, in one commit; False if the writer's batch is in already.

        Of rows that share a key the last by order stays; without an order, any one of them.
        """
        commit = self.last()
        if batch is not None and commit["batches"].get(writer, -1) >= batch:
            return False
        once = self._latest(rows, list(self.order)) if self.order else rows.dropDuplicates(self.keys)
        version = commit["version"] + 1
        part = self._write(once.withColumn("_version", F.lit(version).cast("long")))
        batches = commit["batches"] | ({writer: batch} if batch is not None else {})
        self._commit({"version": version, "schema": json.loads(once.schema.json()), "parts": [*commit["parts"], part], "batches": batches})
        if len(commit["parts"]) + 1 >= COMPACT:
            self.compact()
        return True

    def update(self, changes: DataFrame, batch: int | None = None, writer: str = "main") -> bool:
        """Merges rows that are there with new values of some columns; keys that aren't there are passed over."""
        if batch is not None and self.has(batch, writer):
            return False
        now, new = self.read(), [c for c in changes.columns if c not in self.keys]
        both = now.join(changes.select(*self.keys, *(F.col(c).alias(f"_new_{c}") for c in new)), self.keys)
        return self.merge(both.select(*(F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in now.columns)), batch, writer)

    def compact(self) -> None:
        """Joins all parts to one."""
        commit = self.last()
        if len(commit["parts"]) > 1:
            version = commit["version"] + 1
            part = self._write(self.read().withColumn("_version", F.lit(version).cast("long")))
            self._commit(commit | {"version": version, "parts": [part]})

    def vacuum(self) -> int:
        """Removes what the last commit doesn't name (no reader may be at work on it): parts removed."""
        commit = self.last()
        files, top = self._files(self.path)
        old = [s.getPath() for s in files.listStatus(top) if s.getPath().getName().startswith("part-") and s.getPath().getName() not in commit["parts"]]
        for p in old:
            files.delete(p, True)
        return len(old)
