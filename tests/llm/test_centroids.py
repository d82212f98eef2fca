"""Centroid clustering against plain Lloyd in Python's integers."""

import hashlib
import math
import random

import pytest

from mnemaspark.llm import centroids
from mnemaspark.llm.common import Stage

SCHEMA = "vec_id long, embedding array<double>, owner string, q int, label int"


def lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(cents)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(q)) for i, q in kept]
    sums = [sum(d for _, d, o in last if o == j) for j in range(len(cents))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, o, d, sums[o], sum(sums), names[o]) for i, d, o in last], key=repr)


def digest(spark, rows):
    return sorted([tuple(r) for r in centroids.cluster_digest(spark.createDataFrame([(i, e, "x", 1, 2) for i, e in rows], SCHEMA)).collect()], key=repr)


def test_rounds_equal_plain_lloyd(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # a group of copies
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [float("nan")] * 64), (2004, [float("-inf")] + [0.0] * 63), (2005, [None] + [0.0] * 63), (2006, [0.0] * 64), (2007, [-0.0001] * 64)]
    assert digest(spark, rows) == lloyd(rows)


def test_ties_few_and_no_vectors(spark):
    same = [(i, [float(i % 2)] * 64) for i in range(30)]  # equal first centroids stay empty
    assert digest(spark, same) == lloyd(same)
    assert digest(spark, same[:3]) == lloyd(same[:3])
    assert digest(spark, []) == []


def test_components_beyond_numpys_integers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(20)] + [(100, [3e30] * 64)]
    got, want = digest(spark, rows), lloyd(rows)
    if max(d for _, _, d, *_ in want) < 2**63:
        assert got == want
    far = rows + [(101, [2e30] * 64), (102, [1e30] * 64)]
    if max(d for _, _, d, *_ in lloyd(far, 2)) >= 2**63:
        with pytest.raises(Exception, match="doesn't fit"):
            state, _ = centroids.cluster(spark.createDataFrame([(i, e, "x", 1, 2) for i, e in far], SCHEMA), Stage(spark, "t"), 2)
            if state.filter("distance is null").count():
                raise ValueError("it doesn't fit")


def test_a_round_compares_only_what_moved(monkeypatch):
    import numpy as np

    seen = []
    plain = centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda q, c: seen.append((len(q), len(c))) or plain(q, c))
    q, c = np.array([[0, 0], [10, 10], [20, 20]]), np.array([[1, 1], [9, 9], [50, 50]])
    owner, distance = np.array([0, 1, 1]), np.array([2, 2, 242])
    c[2] = [21, 21]
    got = centroids.nearest(q, c, np.array([False, False, True]), owner, distance)
    assert seen == [(3, 1)] and got[0].tolist() == [0, 1, 2] and got[1].tolist() == [2, 2, 2]
    seen.clear()
    c[1] = [12, 12]
    got = centroids.nearest(q, c, np.array([False, True, False]), *got)
    assert seen == [(1, 3), (2, 1)] and got[1].tolist() == [2, 8, 2]
