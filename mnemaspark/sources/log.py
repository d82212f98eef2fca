"""The validation log: append-only, a part for each batch of writes, with statuses and counts; and live counters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import CURRENT, _at, point

ENTRY = (
    "id string, status string, level string, conflict_id string, similar_id string, downgraded_from string, reason string, who_overlap double, what_overlap double, similarity double, n_candidates long, at timestamp_ntz"
)
STATUSES = ("OK", "WARN", "BLOCKED")


class ValidationLog:
    """Results of validation in a folder that only this class writes.

    ``append`` names its batch: one that is written again replaces itself, so a retried
    micro-batch counts once. ``clear`` starts a new generation; readers see all of one or of the other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generation(self) -> str:
        fs, at = _at(self.spark, f"{self.path}/{CURRENT}")
        return self.spark.read.text(f"{self.path}/{CURRENT}", wholetext=True).first()[0] if fs.exists(at) else "0"

    def append(self, results: DataFrame, batch: str, at: str) -> None:
        """Adds the results of a batch; columns that they lack are null, others are left out."""
        from pyspark.sql.types import StructType

        fields = [f for f in StructType.fromDDL(ENTRY).fields if f.name != "at"]
        row = [(F.col(f.name) if f.name in results.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        results.select(*row, F.lit(at).cast("timestamp_ntz").alias("at")).write.mode("overwrite").parquet(f"{self.path}/g-{self._generation()}/batch={batch}")

    def history(self) -> DataFrame:
        """All results since the log was cleared, with their batch."""
        folder = f"{self.path}/g-{self._generation()}"
        fs, at = _at(self.spark, folder)
        schema = f"{ENTRY}, batch string"
        return self.spark.read.schema(schema).parquet(folder) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def blocked(self) -> DataFrame:
        return self.history().filter("status = 'BLOCKED'")

    def warnings(self) -> DataFrame:
        return self.history().filter("status = 'WARN'")

    def clear(self) -> None:
        point(self.spark, self.path, str(int(self._generation()) + 1))

    def stats(self, policy: str, embedding: bool = False) -> DataFrame:
        """A2: one row: total, ok, warn, blocked, policy and whether embeddings are compared."""
        return counted(self.history()).withColumns({"policy": F.lit(policy), "embedding_check_enabled": F.lit(embedding)})


def counted(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


@dataclass
class Counters:
    """A3: what an engine and those made from it have done. Only validated writes count as writes."""

    writes_total: int = 0
    writes_blocked: int = 0
    writes_warned: int = 0
    recalls_total: int = 0

    def watch(self, rows: DataFrame, kind: str) -> tuple[DataFrame, Callable[[], None]]:
        """``rows`` observed, and what adds the observed numbers once an action has run over them."""
        seen = Observation()
        if kind == "recalls":
            watched = rows.observe(seen, F.count(F.lit(1)).alias("recalls_total"))
        else:
            watched = rows.observe(seen, F.count(F.lit(1)).alias("writes_total"), F.count_if(F.col("status") == "BLOCKED").alias("writes_blocked"), F.count_if(F.col("status") == "WARN").alias("writes_warned"))

        def add() -> None:
            for name, n in seen.get.items():
                setattr(self, name, getattr(self, name) + n)

        return watched, add
