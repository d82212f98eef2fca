"""A stored table of memories, entities or relations that merges changes: versioned, in buckets by id.

A version is a list of one folder for each bucket. A merge reads and rewrites the buckets that
its changes fall in, lists the others as they are, and makes the new list current by one rename, so
that a reader sees a version whole, before or after. A version's number is claimed by creating its
list: of two merges that started from one version the second fails and may be run again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import _at, point

CURRENT = "current.txt"


class ConcurrentMerge(RuntimeError):
    """Another merge made a version first."""


class GraphTable:
    """``schema`` must have id and seq; ``buckets`` is fixed by the first merge."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _text(self, name: str) -> str | None:
        fs, at = _at(self.spark, f"{self.path}/{name}")
        if not fs.exists(at):
            return None
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def version(self) -> int:
        """The current version; 0 before the first merge."""
        return int(self._text(CURRENT) or 0)

    def listed(self, version: int) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        return {int(k): v for k, v in json.loads(self._text(f"v-{version}.json"))["buckets"].items()} if version else {}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the current one."""
        return self._rows(self.listed(self.version() if version is None else version).values())

    def _rows(self, folders) -> DataFrame:
        at = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.hash(F.col("id").cast("string")), F.lit(self.buckets))

    def merge(self, changes: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Rows of ``changes`` replace those of their id or are added, ids of ``deletes`` go; the number of the new version.

        A row that replaces keeps the first ``seq`` of its id. An id in both goes. Of several
        changes to one id the one with the largest ``seq`` is taken. Null ids are refused.
        """
        none = self.spark.createDataFrame([], self.schema)
        new = (none if changes is None else changes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])).withColumn("bucket", self._bucket())
        gone = none.select("id") if deletes is None else deletes.select(F.col("id").cast(self.schema["id"].dataType))
        if not new.filter("id is null").isEmpty():
            raise ValueError("a change has no id")
        base = self.version()
        folders = self.listed(base)
        touched = sorted(r[0] for r in new.select("bucket").union(gone.select(self._bucket())).distinct().collect())  # ``buckets`` numbers
        old = self._rows([folders[b] for b in touched if b in folders]).withColumn("bucket", self._bucket())
        columns = F.struct(*self.schema.names)
        both = old.select("bucket", "id", "seq", columns.alias("r"), F.lit(0).alias("at")).union(new.select("bucket", "id", "seq", columns.alias("r"), F.lit(1).alias("at")))
        last = both.groupBy("bucket", "id").agg(F.max_by("r", F.struct("at", "seq")).alias("r"), F.min_by("seq", F.struct("at", "seq")).alias("first")).join(gone.distinct(), "id", "left_anti")
        rows = last.select("bucket", *[(F.col("first") if n == "seq" else F.col(f"r.{n}")).alias(n) for n in self.schema.names])
        folder = f"data-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, at = _at(self.spark, f"{self.path}/{folder}")
        written = {int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(at) if s.isDirectory()}
        after = {b: f for b, f in folders.items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in written}
        self._publish(base + 1, after)
        return base + 1

    def _publish(self, version: int, folders: dict[int, str]) -> None:
        fs, at = _at(self.spark, f"{self.path}/v-{version}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:
            raise ConcurrentMerge(f"version {version} of {self.path} is there") from e
        out.write(bytearray(json.dumps({"buckets": folders}).encode()))
        out.close()
        point(self.spark, self.path, str(version))

    def vacuum(self, keep: int = 1) -> int:
        """Removes folders that none of the last ``keep`` versions lists, and older lists; how many folders went."""
        now = self.version()
        used = {f.partition("/")[0] for v in range(max(1, now - keep + 1), now + 1) for f in self.listed(v).values()}
        fs, at = _at(self.spark, self.path)
        went = 0
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in used:
                went += fs.delete(s.getPath(), True)
            elif name.startswith("v-") and int(name[2:-5]) <= now - keep:
                fs.delete(s.getPath(), False)
        return went
