"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. A forest of random hyperplane trees deals the nodes of
a label into small leaves; each leaf gives its nodes their first neighbours. Overfull leaves are
cut further, and what can't be cut is compared block against block. Then the graph is
refined: every node brings its neighbours, and the nodes that have it as a neighbour,
together, and those learn of each other (neighbours of neighbours), until a round finds no
new link. Lists keep the ``K`` best. Where a list is full of links (saturated) it cannot hold
them all: leaves and rounds also report a spanning forest of all links they see, so no
connection is lost, and in the end the list of a node is enlarged to its whole component, whose
links are counted exactly, block against block, without making pairs.

The number of trees follows from the depth, so that a pair at the threshold meets in a leaf
with a chance of 1 - ``MISS`` whatever the number of vectors. A sample of nodes that has at
least ``AUDIT`` links (all nodes, if the table has fewer) is compared with all nodes of its
label; if a link is missing, a further forest is grown, and after the last one all pairs of
a label are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import count, groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage
from .graph import components

THRESHOLD = 0.98
K = 8
LEAF = 200
LEAF_MAX = 512
MISS = 1e-4
#: Cuts of overfull leaves: random directions to choose from, times at most; each side has at most 0.5 + WIDE of the nodes.
DIRECTIONS = 4
LEVELS = 60
WIDE = 0.15
#: 0.75 of the standard deviation of what a pair at the threshold differs by on a direction (scaled by the root of the dimensions).
GAP = 0.75 * math.sqrt(2 - 2 * THRESHOLD)
AUDIT = 256
BLOCK = 1024
FORESTS = 3


def _unit(label: str | None, emb) -> tuple[str | None, int | None, bytes | None]:
    """(grp, node, unit) of a row, nulls if it can't link."""
    if label is None or not emb.is_valid or emb.values.null_count or not len(emb.values):
        return None, None, None
    v = emb.values.to_numpy(zero_copy_only=False).astype(np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None, None, None
    unit = v / top
    unit = unit / np.sqrt(unit @ unit)
    grp = f"{label}/{len(v)}"
    node = xxhash.xxh64(v.tobytes(), seed=xxhash.xxh32_intdigest(grp)).intdigest()
    return grp, node - (1 << 64) if node >> 63 else node, unit.tobytes()


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, grp, node, unit) of every row; all but vec_id are null where a row can't link.

    node is a 64-bit hash of label and components, grp names label and length.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [_unit(label, emb) for label, emb in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            columns = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True))], names=["vec_id", "grp", "node", "unit"])

    rows = table.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id long, grp string, node long, unit binary")


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), -1)


def _forest_edges(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    seen, out = np.zeros(len(links), bool), []
    for root in np.flatnonzero(links.any(axis=1)):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            x = stack.pop()
            for y in np.flatnonzero(links[x] & ~seen):
                seen[y] = True
                out.append((x, y))
                stack.append(y)
    return out


def _compared(rows: list[tuple[int, bytes]], top: int) -> tuple[list[int], list[int], list[float], list[bool]]:
    """Each node's ``top`` best neighbours among ``rows``, and a spanning forest of the links."""
    nodes = np.array([r[0] for r in rows])
    x = _matrix([r[1] for r in rows])
    sim = x @ x.T
    np.fill_diagonal(sim, -2.0)
    k = min(top, len(rows) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    a, b = np.repeat(np.arange(len(rows)), k), best.ravel()
    spanning = _forest_edges(sim >= THRESHOLD)
    a = np.concatenate([a, [s for s, _ in spanning]]).astype(int)
    b = np.concatenate([b, [t for _, t in spanning]]).astype(int)
    tree = np.arange(len(a)) >= len(rows) * k
    return nodes[a], nodes[b], sim[a, b], tree


def _groups(batches, key: int = 0) -> Iterator[tuple]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[key])


def _join(together: DataFrame, key: str, top: int) -> DataFrame:
    """(a, b, sim, tree) of the nodes that share a key; ``together`` has (key, node, unit)."""

    def run(batches):
        import pyarrow as pa

        made: list[list] = [[], [], [], []]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(made, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["a", "b", "sim", "tree"])

        size = 0
        for _, rows in _groups(batches):
            own = [(node, unit) for _, node, unit in rows]
            if len(own) < 2:
                continue
            got = _compared(own, top)
            for column, x in zip(made, got, strict=True):
                column.append(x)
            size += len(got[0])
            if size > 50_000:
                yield batch()
                made, size = [[], [], [], []], 0
        if size:
            yield batch()

    rows = together.select(key, "node", "unit").repartition(key).sortWithinPartitions(key, "node")
    return rows.mapInArrow(run, "a long, b long, sim double, tree boolean")


def _projected(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """(leaf, node, unit, at): ``at`` is the place of the vector on each of ``DIRECTIONS`` random directions of its tree."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            trees = [int(leaf.rsplit("/", 2)[1]) for leaf in b.column(0).to_pylist()]
            units, at = b.column(2).to_pylist(), np.zeros((len(trees), DIRECTIONS))
            own: dict[tuple[int, int], list[int]] = {}
            for i, t in enumerate(trees):
                own.setdefault((t, len(units[i]) // 8), []).append(i)
            for (t, dims), rows in own.items():
                u = np.random.default_rng([seed, t, dims, level + 1]).standard_normal((dims, DIRECTIONS))
                at[rows] = _matrix([units[i] for i in rows]) @ (u / np.linalg.norm(u, axis=0)) * math.sqrt(dims)
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(trees) + 1, dtype=np.int32) * DIRECTIONS), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), places], names=["leaf", "node", "unit", "at"])

    return rows.select("leaf", "node", "unit").mapInArrow(run, "leaf string, node long, unit binary, at array<double>")


def _blocks(rows: DataFrame) -> DataFrame:
    """(leaf, node, unit) such that all pairs of an old leaf meet in some new one, of two blocks of at most about ``LEAF_MAX`` nodes."""
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_MAX).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "leaf").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("own <> other or blocks = 1")
    return dealt.select(F.concat_ws("/", "leaf", F.lit("block"), F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "node", "unit")


def _leaves(nodes: DataFrame, depth: dict[str, int], trees: int, seed: int, stage: Stage) -> DataFrame:
    """(leaf, node, unit) for each tree.

    A leaf of over ``LEAF_MAX`` nodes, such as a narrow cone that no plane through the origin
    cuts, is halved at the median of the widest of some directions, again and again. Nodes
    within ``GAP`` of the cut go to both sides, so that a pair at the threshold is cut apart
    less often than by a plane. Where no direction is wide enough for that, all pairs of the
    leaf are compared, once if trees have the same leaf.
    """

    def run(batches):
        import pyarrow as pa

        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            grps, ids, units = (b.column(i).to_pylist() for i in range(3))
            leaf, node, unit = [], [], []
            for g in sorted(set(grps)):
                at = [i for i, x in enumerate(grps) if x == g]
                x = _matrix([units[i] for i in at])
                dims, bits = x.shape[1], depth[g]
                for t in range(trees):
                    if (t, dims) not in planes:
                        planes[t, dims] = np.random.default_rng([seed, t, dims]).standard_normal((dims, 48))
                    code = ((x @ planes[t, dims][:, :bits]) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(at), np.int64)
                    leaf += [f"{g}/{t}/{c}" for c in code.tolist()]
                    node += [ids[i] for i in at]
                    unit += [units[i] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(node, pa.int64()), pa.array(unit, pa.binary())], names=["leaf", "node", "unit"])

    dealt = nodes.select("grp", "node", "unit").mapInArrow(run, "leaf string, node long, unit binary")
    over = stage.write(dealt.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF_MAX).select("leaf"), f"over-{seed}")
    if over.isEmpty():
        return dealt
    fit, stuck = [dealt.join(over, "leaf", "left_anti")], []
    open_ = dealt.join(over, "leaf", "left_semi")
    for level in range(LEVELS):
        open_ = stage.write(_projected(open_, seed, level), f"open-{seed}-{level}")
        places = [F.percentile_approx(F.col("at")[i], [0.5 - WIDE, 0.5, 0.5 + WIDE], 1000) for i in range(DIRECTIONS)]
        cuts = [F.struct(F.least(p[2] - p[1], p[1] - p[0]).alias("wide"), F.lit(i).alias("i"), p[1].alias("mid")) for i, p in enumerate(places)]
        shape = open_.groupBy("leaf").agg(F.count("*").alias("n"), F.greatest(*cuts).alias("cut"))
        shape = stage.write(shape.select("leaf", "n", "cut.*"), f"shape-{seed}-{level}")
        own = open_.join(shape, "leaf")
        narrow = F.col("wide") < GAP
        fit.append(own.filter(F.col("n") <= LEAF_MAX).select("leaf", "node", "unit"))
        stuck.append(own.filter((F.col("n") > LEAF_MAX) & narrow).select("leaf", "node", "unit"))
        place = F.get("at", F.col("i"))
        sides = F.array_compact(F.array(F.when(place <= F.col("mid") + GAP, F.lit("0")), F.when(place > F.col("mid") - GAP, F.lit("1"))))
        # the side goes before the tree, which keeps its place from the right
        parts = [F.regexp_extract("leaf", r"(?s)^(.*)(/\d+/\d+)$", i) for i in (1, 2)]
        open_ = own.filter((F.col("n") > LEAF_MAX) & ~narrow).withColumn("side", F.explode(sides)).select(F.concat(parts[0], F.lit("/"), "side", parts[1]).alias("leaf"), "node", "unit")
        if shape.filter((F.col("n") > LEAF_MAX) & ~narrow).isEmpty():
            break
    else:
        stuck.append(open_)
    left = stage.write(reduce(DataFrame.union, stuck), f"stuck-{seed}")
    same = left.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    first = same.groupBy("n", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf")
    return reduce(DataFrame.union, [*fit, _blocks(left.join(first, "leaf", "left_semi"))])


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _round(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that meet at a common neighbour."""
    forward = graph.select(F.col("a").alias("at"), F.col("b").alias("node"))
    fair = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))
    back = graph.withColumn("place", F.row_number().over(fair)).filter(F.col("place") <= K).select(F.col("b").alias("at"), F.col("a").alias("node"))
    own = nodes.select(F.col("node").alias("at"), "node")
    met = forward.union(back).union(own).distinct()
    return _join(met.join(nodes.select("node", "unit"), "node"), "at", 4)


def _of_sample(nodes: DataFrame, share: float) -> DataFrame:
    """Links (a, b) of a sample of the nodes (a), against all nodes of their labels (b), block against block."""
    asked = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * share))
    sizes = nodes.groupBy("grp").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("blocks"), F.ceil(F.count_if(asked) / BLOCK).cast("int").alias("parts"))
    dealt = nodes.select("grp", "node", "unit").join(sizes.filter("parts > 0"), "grp")
    part = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = dealt.filter(asked).withColumn("p", part("parts", 12)).withColumn("q", upto("blocks")).withColumn("side", F.lit(0))
    y = dealt.withColumn("q", part("blocks", 13)).withColumn("p", upto("parts")).withColumn("side", F.lit(1))
    cells = x.unionByName(y).select(F.concat_ws("/", "grp", "p", "q").alias("cell"), "side", "node", "unit")

    def run(batches):
        import pyarrow as pa

        for _, rows in _groups(batches):
            own = list(rows)
            a, b = ([r for r in own if r[1] == side] for side in (0, 1))
            if a and b:
                hit = np.nonzero(_matrix([r[3] for r in a]) @ _matrix([r[3] for r in b]).T >= THRESHOLD)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r[2] for r in x])[i]) for x, i in zip((a, b), hit, strict=True)], names=["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell", "side", "node").mapInArrow(run, "a long, b long").filter("a <> b")


def _audit(nodes: DataFrame, total: int, stage: Stage) -> DataFrame:
    """Links of sampled nodes, against all nodes of their labels.

    The sample starts with about ``AUDIT`` nodes and grows until they have ``AUDIT`` links or
    it is the whole table.
    """
    share = min(1.0, AUDIT / max(total, 1))
    while True:
        truth = stage.write(_of_sample(nodes, share), f"audit-{share}")
        if share == 1.0 or truth.count() >= AUDIT:
            return truth
        share = min(1.0, 8 * share)


def _recall(truth: DataFrame, found: DataFrame) -> float:
    """The share of the links (a, b) whose ends are in one component."""
    x, y = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    seen = truth.join(x, "a", "left").join(y, "b", "left").agg(F.count("*").alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("hit")).first()
    return seen["hit"] / seen["n"] if seen["n"] else 1.0


def _degrees(placed: DataFrame, stage: Stage) -> DataFrame:
    """(node, links): for each node the copies of the nodes of its component that it links with.

    ``placed`` has (component, node, unit, copies). Components are cut into blocks of about
    ``BLOCK`` nodes; each pair of blocks is compared once and gives counts, one for each node.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1").select("component", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "unit", "copies")
    met = met.withColumn("cell", F.concat_ws("/", "component", "p", "q")).repartition("cell").sortWithinPartitions("cell", "own", "node")

    def run(batches):
        import pyarrow as pa

        nodes, links = [], []
        for _, rows in _groups(batches):
            own = list(rows)
            p, q = own[0][1], own[0][2]
            x = [r for r in own if r[3] == p]
            y = x if p == q else [r for r in own if r[3] == q]
            if not x or not y:
                continue
            hit = _matrix([r[5] for r in x]) @ _matrix([r[5] for r in y]).T >= THRESHOLD
            if p == q:
                np.fill_diagonal(hit, False)
            nodes.append(np.array([r[4] for r in x]))
            links.append(hit @ np.array([r[6] for r in y], dtype=np.int64))
            if p != q:
                nodes.append(np.array([r[4] for r in y]))
                links.append(hit.T @ np.array([r[6] for r in x], dtype=np.int64))
            if len(nodes) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])
                nodes, links = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])

    cells = met.select("cell", "p", "q", "own", "node", "unit", "copies")
    return cells.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def dedup(table: DataFrame, stage: Stage) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for every row of ``table``.

    Rows with a null label, or a vector that is null, empty, zero, or holds null or
    non-finite components, link with nothing; so do rows of different labels or lengths.
    Every row counts, also those with equal vec_ids; rows without vec_id link as others
    do and have the component of their links, or null. audit_recall is the share of the
    sampled links that are connected in the result, before components are completed.
    """
    rows = stage.write(vectors(table), "rows")
    nodes = stage.write(rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("grp").alias("grp"), F.first("unit").alias("unit")), "nodes")
    counts = {r["grp"]: r["n"] for r in nodes.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row for each label and length
    depth = {g: max(0, math.ceil(math.log2(max(n, 1) / LEAF))) for g, n in counts.items()}
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** max(depth.values(), default=0)
    trees = max(1, math.ceil(math.log(MISS) / math.log(max(1 - meet, 1e-9))))
    total = sum(counts.values())
    truth = _audit(nodes, total, stage)
    links, graph, recall = None, None, 1.0
    for forest in range(FORESTS):
        met = stage.write(_join(_leaves(nodes, depth, trees, 100 + forest, stage), "leaf", K), f"leaf-{forest}")
        links = stage.write(_fresh(met) if links is None else links.union(_fresh(met)).distinct(), f"links-{forest}")
        graph = stage.write(_best(met.select("a", "b", "sim") if graph is None else graph.union(met.select("a", "b", "sim")), K), f"graph-{forest}")
        for i in count():
            met = stage.write(_round(graph, nodes), f"met-{forest}-{i}")
            fresh = stage.write(_fresh(met).join(links, ["a", "b"], "left_anti"), f"fresh-{forest}-{i}")
            if fresh.isEmpty():
                break
            graph = stage.write(_best(graph.union(met.select("a", "b", "sim")), K), f"graph-{forest}-{i}")
            links = stage.write(links.union(fresh), f"links-{forest}-{i}")
            if i:
                for name in ("met", "fresh", "graph", "links"):
                    stage.drop(f"{name}-{forest}-{i - 1}")
        found = components(links, stage, f"c{forest}")
        recall = _recall(truth, found)
        if recall == 1.0:
            break
    else:
        # the exact way: every pair of a label
        every = nodes.select(F.col("grp").alias("leaf"), "node", "unit")
        found = components(links.union(_fresh(_join(_blocks(every), "leaf", 1))), stage, "every")
        recall = _recall(truth, found)
        if recall < 1.0:
            raise RuntimeError(f"{recall} of the sampled links found after all pairs were compared")
    placed = stage.write(nodes.join(found, "node").select("component", "node", "first", "unit", "copies"), "placed")
    degrees = stage.write(_degrees(placed, stage), "degrees")
    smallest = placed.groupBy("component").agg(F.min("first").alias("smallest"))
    linked = placed.join(smallest, "component").select("node", "smallest").join(degrees, "node", "left")
    info = nodes.join(linked, "node", "left").select(
        F.col("node").alias("op2_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.least("first", "smallest").alias("component_id"))
    out = rows.select("vec_id", "node").join(info, F.col("node") == F.col("op2_node"), "left")
    component = F.when(F.col("op2_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))


def _fresh(met: DataFrame) -> DataFrame:
    return met.filter("tree").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def embedding_digest(table: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``table``."""
    return dedup(table, Stage(table.sparkSession, "op2"))
