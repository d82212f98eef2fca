"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

ROUNDS = 60


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is its smallest node.

    A round gives each node the least label among its neighbours, then replaces a label by
    that label's own label, so a path of length n takes about log n rounds. Minima are
    combined before they are shuffled. Each round is written, and ends the lineage.
    """
    both = stage.write(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges")
    labels = stage.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), f"{name}-0")
    for i in range(1, ROUNDS):
        seen = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("old"))
        least = labels.select("node", "component", F.col("component").alias("old")).union(seen).groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = least.join(jump, F.col("component") == F.col("at"), "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old")
        new = stage.write(new, f"{name}-{i}")
        changed = new.filter("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if i > 1:
            stage.drop(f"{name}-{i - 2}")
        if not changed:
            return labels
    raise RuntimeError(f"no fixpoint after {ROUNDS} rounds")
