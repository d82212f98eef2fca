"""Ranking by vectors: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Rows (id, embedding, block) in blocks of about ``BLOCK``, and how many blocks."""
    live = rows.filter("embedding is not null")
    blocks = max(1, -(-live.count() // BLOCK))
    return live.select(F.col(key).alias("id"), "embedding", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")), blocks


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.3, own: bool = False) -> DataFrame:
    """(query_id, vec_id, sim, rank): the k most similar rows (vec_id, embedding) of every query (query_id, embedding).

    Blocks of queries meet blocks of rows; each meeting keeps its k best of a query, so what
    is ranked is k rows for each query and block. A row is not compared with the query of
    its own id, unless ``own`` (ids of two tables). Null and zero vectors are similar to none; equal similarities go by vec_id.
    """

    def run(t):
        import pyarrow as pa

        t = t.combine_chunks()
        asks, ids, lists = (t.column(n).to_numpy() for n in ("asks", "id", "embedding"))
        if len({len(v) for v in lists}) > 1:
            raise ValueError("vectors differ in length")
        vectors = np.array([np.asarray(v, dtype=float) for v in lists])
        order = np.argsort(ids, kind="stable")
        asks, ids, vectors = asks[order], ids[order], vectors[order]
        q, x, qid, ids = vectors[asks], vectors[~asks], ids[asks], ids[~asks]
        if not len(qid) or not len(ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.nan_to_num((q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]))
        if not own:
            sim[qid[:, None] == ids[None, :]] = -2
        n = min(k, len(ids))
        at = np.argsort(-sim, axis=1, kind="stable")[:, :n]
        s = np.take_along_axis(sim, at, axis=1)
        keep = s >= least
        return pa.table({"query_id": np.repeat(qid, n).reshape(-1, n)[keep], "vec_id": ids[at][keep], "sim": s[keep]})

    (asked, many), (all_, blocks) = _dealt(queries, "query_id"), _dealt(rows, "vec_id")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # a group is one block of queries and one of rows, so a worker holds about 2 * BLOCK vectors, however many groups a task has
    met = asked.select(F.lit(True).alias("asks"), "id", "embedding", F.col("block").alias("q"), each(blocks, "x")).unionByName(all_.select(F.lit(False).alias("asks"), "id", "embedding", F.col("block").alias("x"), each(many, "q")))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    found = met.groupBy("q", "x").applyInArrow(run, "query_id long, vec_id long, sim double")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def inherit(nearest: DataFrame, memories: DataFrame) -> DataFrame:
    """What a text takes over from its nearest memory: place, language, and importance times 0.8."""
    first = nearest.filter("rank = 1")
    return first.join(memories, first["vec_id"] == memories["id"]).select("query_id", "vec_id", "sim", "place", "lang", (F.col("importance") * 0.8).alias("importance"))
