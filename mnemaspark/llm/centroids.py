"""Clustering by centroids: Lloyd's rounds in integers, each of which does only what the round before changed.

The state, a row for each vector (its integers, owner and squared distance), is a table in the
shared folder. A round reads it once and writes the next: a vector whose owner's centroid stayed
is compared with the centroids that moved alone, since all others lost to its owner before; only
a vector whose owner moved is compared with all. Vectors that change hands are summed, signed,
inside each task; a task adds one short row for each centroid it took from or gave to, and the
exact global sums follow from these rows. The vectors are never shuffled.

What the driver holds is ``k`` centroids and their sums, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

WIDTH, SCALE, K, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components below this fit numpy's integers: 64 squares of a difference stay under 2 ** 63.
NARROW = 1 << 27
#: Transfers travel as two decimals, high * SPLIT + low, so that no component overflows one.
SPLIT = 10**30
STATE = "kind string, vec_id long, q binary, wide string, owner int, distance long, delta array<decimal(38,0)>"


def usable(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, embedding) of the rows with ``width`` components, none of them null or not finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter((F.size("embedding") == width) & ~bad).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def integers(row: list[float]) -> list[int]:
    """floor(SCALE * x) of each component, exact for large ones too."""
    return [int(x) * SCALE if abs(x) >= 2.0**52 else int(np.floor(SCALE * x)) for x in row]


def seeds(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The first centroids: the ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [integers(r["embedding"]) for r in rows.orderBy(order, "embedding").limit(k).collect()]


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows ``q`` and centroids ``c``; in Python's integers where numpy's are too short."""
    if q.dtype == object or max(map(abs, c.ravel().tolist()), default=0) >= NARROW:
        q, c = q.astype(object), c.astype(object)
    out = np.empty((len(q), len(c)), dtype=q.dtype)
    for j, row in enumerate(c):
        out[:, j] = ((q - row) ** 2).sum(axis=1)
    return out


def nearest(q: np.ndarray, centroids: np.ndarray, moved: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids ``moved`` (booleans) have changed; an owner of -1 has none yet."""
    owner, distance = owner.copy(), distance.copy()
    again = (owner < 0) | moved[owner]
    if again.any():
        d = squared(q[again], centroids)
        owner[again] = d.argmin(axis=1)
        distance[again] = d.min(axis=1)
    some = np.flatnonzero(moved)
    if len(some) and not again.all():
        d = squared(q[~again], centroids[some])
        at, low = some[d.argmin(axis=1)], d.min(axis=1)
        o, was = owner[~again], distance[~again]
        better = (low < was) | ((low == was) & (at < o))
        owner[~again], distance[~again] = np.where(better, at, o), np.where(better, low, was)
    return owner, distance


@dataclass
class Transfers:
    """Signed sums and counts by centroid of the vectors that changed hands in a task."""

    width: int
    sums: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, q: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        went = old != new
        for owners, sign in ((old, -1), (new, 1)):
            for j in np.unique(owners[went & (owners >= 0)]):
                own = q[went & (owners == j)]
                total = np.array([*map(int, own.sum(axis=0)), len(own)], dtype=object) * sign
                self.sums[int(j)] = self.sums.get(int(j), np.zeros(self.width + 1, dtype=object)) + total

    def rows(self) -> list[tuple[int, list[int]]]:
        """(centroid, high parts then low parts) of what was moved."""
        return [(j, [*(int(x) // SPLIT for x in s), *(int(x) % SPLIT for x in s)]) for j, s in sorted(self.sums.items())]


def _first(rows: DataFrame) -> DataFrame:
    """The state before any round: vectors as integers, without owners."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            # the filter has left lists of equal length without nulls
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            narrow = (np.abs(x) < NARROW // SCALE).all(axis=1)
            q = np.floor(SCALE * np.where(narrow[:, None], x, 0.0)).astype("<i4")
            wide = [None if n else ",".join(map(str, integers(r))) for n, r in zip(narrow, x.tolist(), strict=True)]
            yield _batch(pa, b.column(0), [r.tobytes() if n else None for n, r in zip(narrow, q, strict=True)], wide, np.full(len(x), -1), [None] * len(x))

    return rows.mapInArrow(run, STATE)


def _batch(pa, ids, q, wide, owner, distance):
    n = len(owner)
    return pa.RecordBatch.from_arrays([
        pa.array(["state"] * n, pa.string()), ids, pa.array(q, pa.binary()), pa.array(wide, pa.string()), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()),
        pa.nulls(n, pa.list_(pa.decimal128(38, 0)))], names=["kind", "vec_id", "q", "wide", "owner", "distance", "delta"])


def _round(state: DataFrame, centroids: list[list[int]], moved: list[bool], width: int) -> DataFrame:
    """The next state and the transfers to it, as rows of two kinds."""

    def run(batches):
        from decimal import Decimal

        import pyarrow as pa

        own, gone = np.array(centroids, dtype=object).reshape(-1, width), np.array([*moved, False])
        if max(map(abs, own.ravel().tolist()), default=0) < NARROW:
            own = own.astype(np.int64)
        sent = Transfers(width)
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name))  # noqa: B023, E731
            qs, wide, old = column("q").to_pylist(), column("wide").to_pylist(), column("owner").to_numpy(zero_copy_only=False)
            owner, distance = old.copy(), np.array(column("distance").to_pylist(), dtype=object)
            narrow = np.array([q is not None for q in qs], dtype=bool)
            for pick in (narrow, ~narrow):
                if not pick.any():
                    continue
                if pick is narrow:
                    q = np.frombuffer(b"".join(x for x in qs if x is not None), dtype="<i4").reshape(-1, width).astype(np.int64)
                    was = np.array([-1 if d is None else d for d in distance[pick]], dtype=own.dtype)
                    owner[pick], distance[pick] = nearest(q, own, gone[:-1], old[pick], was)
                else:
                    # the few whose distances may not fit a long are compared with all in every round
                    q = np.array([[*map(int, w.split(","))] for w in wide if w is not None], dtype=object)
                    none = np.full(len(q), -1)
                    owner[pick], distance[pick] = nearest(q, own, gone[:-1], none, none.astype(object))
                sent.add(q, old[pick], owner[pick])
            kept = [None if n is False and d > 2**63 - 1 else int(d) for n, d in zip(narrow.tolist(), distance, strict=True)]
            yield _batch(pa, column("vec_id"), column("q"), column("wide"), owner, kept)
        if rows := sent.rows():
            n = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(["transfer"] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), pa.array([j for j, _ in rows], pa.int32()), pa.nulls(n, pa.int64()),
                pa.array([[Decimal(x) for x in d] for _, d in rows], pa.list_(pa.decimal128(38, 0)))], names=["kind", "vec_id", "q", "wide", "owner", "distance", "delta"])

    return state.mapInArrow(run, STATE)


def _received(written: DataFrame, k: int, width: int) -> list[list[int]]:
    """What each centroid gained, component by component, and its count; k rows of width + 1."""
    parts = written.filter("kind = 'transfer'").select("owner", F.posexplode("delta").alias("at", "d")).groupBy("owner", "at").agg(F.sum("d").alias("d"))
    out = [[0] * (width + 1) for _ in range(k)]
    for r in parts.collect():  # 2 * (width + 1) rows for each centroid
        high, at = divmod(r["at"], width + 1)
        out[r["owner"]][at] += int(r["d"]) * (1 if high else SPLIT)
    return out


def cluster(vectors: DataFrame, stage: Stage, k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> tuple[DataFrame, list[list[int]]]:
    """(state: vec_id, owner, distance; the final centroids) after ``rounds`` rounds and one assignment more.

    Vectors of another width, null ones and those with null or non-finite components are left
    out; a table of fewer than ``k`` usable vectors has as many centroids, an empty one none.
    Repeated vec_ids are vectors of their own; a null vec_id counts as empty text in the order
    of the first centroids, in which equal ids go by their components. Other columns are
    ignored. A distance that doesn't fit a long is an error. Rounds end early at a fixpoint,
    after which none would change anything.
    """
    rows = usable(vectors, width)
    centroids = seeds(rows, k, seed)
    state = stage.write(_first(rows), "state-0")
    if not centroids:
        return state, []
    k = len(centroids)
    sums, moved = [[0] * (width + 1) for _ in range(k)], [True] * k
    for i in range(1, rounds + 2):
        at = f"state-{i}"
        written = stage.write(_round(state.filter("kind = 'state'"), centroids, moved, width), at, "kind")
        stage.drop(f"state-{i - 1}")
        state = written
        if i > rounds:
            break
        for own, gain in zip(sums, _received(written, k, width), strict=True):
            own[:] = [a + g for a, g in zip(own, gain, strict=True)]
        after = [[x // s[-1] for x in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids, strict=True)]
        moved = [a != c for a, c in zip(after, centroids, strict=True)]
        centroids = after
        if not any(moved):
            break
    return state.filter("kind = 'state'"), centroids


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """The digest result: one row for each usable vector."""
    state, centroids = cluster(vectors, Stage(vectors.sparkSession, "op13"))
    distance = F.when(F.col("distance").isNull(), F.raise_error(F.lit("a squared distance doesn't fit a long"))).otherwise(F.col("distance")).cast("long")
    rows = state.select("vec_id", F.col("owner").alias("cluster"), distance.alias("distance"))
    inertia = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    named = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    # k rows
    found = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
