"""Near-duplicate documents: SetSketch bands, joint likelihood, verification on full sets.

1. Each text becomes its set of five-word shingles (64-bit hashes), a 128-bit hash of the
   whole set and a sketch. Documents of equal sets are one class from here on.
2. Bands of register values are hashed; a bucket is the classes that share one. Buckets are
   aggregated, never listed: a bucket gives each member its smallest class as leader.
3. Each class is verified against the leader it shares most bands with; verified links give
   components. From here on a component is one node of any graph.
4. Of buckets that hold several components, the smallest members of those are verified
   against one of them.
5. What is left are buckets that still hold several components. Components that buckets
   connect are a family; its classes are compared block against block, sizes first, then the
   likelihood estimate, then the full sets, so a link is never lost for want of a leader.
   Pairs inside a component are never made, and only links leave a task.

Verification ships each set once to the partition of its leader, salted where a leader has
many members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Stage, append, without, worker_model
from .graph import components
from .setsketch import M, at_least, mix, sketch

WORDS = 5
#: Bands are made so that a pair at the threshold shares none with at most this chance.
MISS = 1e-8
#: Standard errors of the estimate below the threshold from which a pair is ruled out.
ERRORS = 5
MEMO = 200_000
CHUNK = 1 << 19
PER_SALT = 512
#: Classes, and shingles of them, in a block of a family.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
COLUMNS = 4096


class Rule(NamedTuple):
    """Sets are linked where denominator * intersection >= numerator * union."""

    numerator: int = 85
    denominator: int = 100

    @property
    def share(self) -> float:
        return self.numerator / self.denominator

    @property
    def rows(self) -> int:
        """Registers in a band: as many as ``MISS`` allows."""
        return max(r for r in range(1, M) if r == 1 or (1 - self.share**r) ** (M // r) <= MISS)

    @property
    def least(self) -> float:
        """Pairs estimated below this are no candidates."""
        return self.share - ERRORS * (self.share * (1 - self.share) / M) ** 0.5

    def sized(self, a: str, b: str) -> str:
        return f"{self.denominator} * least({a}, {b}) >= {self.numerator} * greatest({a}, {b})"


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WORDS)], dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text."""

    def __init__(self):
        self.memo = Memo(lambda words: [xxhash.xxh64_intdigest(w) for w in words], MEMO)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.array([], dtype=np.uint64)
        h = np.array(self.memo.of(words), dtype=np.uint64)
        if len(h) < WORDS:
            out = np.array([len(h)], dtype=np.uint64)
            for i in range(len(h)):
                out = mix(out * _POWERS[1] + h[i : i + 1])
            return out
        n = len(h) - WORDS + 1
        total = reduce(np.add, [h[i : i + n] * _POWERS[i] for i in range(WORDS)])
        return np.unique(mix(total))


def _names(own: np.ndarray) -> list[int]:
    """128 bits that name a set."""
    return [int(x.sum(dtype=np.uint64).view(np.int64)) for x in (own, mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)))]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), s1, s2 (hash of the set), regs (binary) of every row."""

    def run(batch):
        import pyarrow as pa

        shingle = worker_model("shingles", Shingler)
        n, s1, s2, regs, sets, size = [], [], [], [], [], 0

        def flush():
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            regs.extend(r.tobytes() for r in sketch(np.concatenate(sets), sizes))
            sets.clear()

        for text in batch.column(batch.schema.get_field_index("text")):
            own = shingle(text.as_py())
            n.append(len(own))
            for column, name in zip((s1, s2), _names(own), strict=True):
                column.append(name)
            sets.append(own)
            size += len(own)
            if size > CHUNK:
                flush()
                size = 0
        if sets:
            flush()
        return [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(regs, pa.binary())]

    return append(docs.select("doc_id", "text"), "n long, s1 long, s2 long, regs binary", run, ("text",))


def _bands(classes: DataFrame, rows: int) -> DataFrame:
    """(id, bands): a key for each band of each class."""
    bands = M // rows

    def run(batches):
        import pyarrow as pa

        for b in batches:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u2").reshape(-1, M)[:, : bands * rows].astype(np.uint64)
            key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(regs), 1))
            for i in range(rows):
                key = mix(key * _POWERS[1] + regs[:, i::rows])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(regs) + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), keys], names=["id", "bands"])

    return classes.select("id", "regs").mapInArrow(run, "id long, bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sizes and joint estimate leave a link possible."""
    a = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    b = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches):
        import pyarrow as pa

        for t in batches:
            u, v = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype="<u2").reshape(-1, M) for c in (3, 5))
            yield t.select(["a", "b"]).filter(pa.array(at_least(rule.least, u, v, t.column(2).to_numpy(), t.column(4).to_numpy())))

    sized = pairs.join(a, "a").join(b, "b").filter(rule.sized("na", "nb"))
    return sized.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are links, decided on full sets."""
    salts = pairs.groupBy("a").agg(F.count("*").alias("members")).select("a", F.ceil(F.col("members") / PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    member = salted.join(sets, F.col("b") == F.col("id")).select("a", "salt", "b", "hashes")
    leader = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "hashes")
    together = leader.union(member).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")

    def run(batches):
        import pyarrow as pa

        own, at = None, None
        for t in batches:
            a, b = [], []
            for x, y, raw in zip(t.column(0).to_pylist(), t.column(2).to_pylist(), t.column(3), strict=True):
                hashes = np.frombuffer(raw.as_py(), dtype="<u8")
                if y is None:
                    own, at = hashes, x
                    continue
                assert at == x
                common = len(np.intersect1d(own, hashes, assume_unique=True))
                if rule.denominator * common >= rule.numerator * (len(own) + len(hashes) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the classes ``wanted`` (id, n, s1, s2); of a repeated doc_id the text of its class."""

    def run(batches):
        import pyarrow as pa

        shingle = worker_model("shingles", Shingler)
        for t in batches:
            ids, made = [], []
            for doc, text, *name in zip(t.column(0).to_pylist(), t.column(1), *(t.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                own = shingle(text.as_py())
                if [len(own), *_names(own)] == name:
                    ids.append(doc)
                    made.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.binary())], names=["id", "hashes"])

    own = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id")).select("id", "text", "n", "s1", "s2")
    return own.mapInArrow(run, "id long, hashes binary").dropDuplicates(["id"])


def link(docs: DataFrame, stage: Stage, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Null and empty texts have no shingles, link with nothing and are their own component.
    Rows without doc_id are kept, apart from all others, with a null component. Rows of one
    doc_id are one document: its set is that of least size, then least hash, of its texts that
    have shingles. Other columns are ignored.
    """
    rows = stage.write(sketches(docs), "rows")
    single = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("name")).select("doc_id", "name.*")
    single = stage.write(single, "single")
    grouped = single.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    member = stage.write(single.join(grouped, ["n", "s1", "s2"]).select("doc_id", "id", "n", "s1", "s2"), "member")
    own = member.filter("doc_id = id").select("id", "n", "s1", "s2")
    classes = stage.write(rows.select(F.col("doc_id").alias("id"), "n", "s1", "s2", "regs").join(own, ["id", "n", "s1", "s2"], "left_semi").dropDuplicates(["id"]), "classes")

    entries = _bands(classes, rule.rows).select("id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    shared = stage.write(entries.join(buckets, "key").select("key", "id", "leader"), "shared")
    led = shared.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("bands"))
    best = led.groupBy("id").agg(F.max_by("leader", F.struct("bands", -F.col("leader"))).alias("leader"))
    met = classes.join(shared.select("id").distinct(), "id", "left_semi")
    sets = stage.write(_sets(docs, met.select("id", "n", "s1", "s2")), "sets")
    first = stage.write(_likely(best.select(F.col("leader").alias("a"), F.col("id").alias("b")), classes, rule), "first")
    links = stage.write(_verified(first, sets, rule), "links-0")
    labels = stage.write(met.select("id", F.col("id").alias("component")), "labels-0")
    labels = _joined(labels, links, stage, 1)
    open_ = _open(shared, labels, stage, 1)
    across = stage.write(_likely(_heads(open_), classes, rule), "across")
    links = stage.write(_verified(across, sets, rule), "links-1")
    labels = _joined(labels, links, stage, 2)
    links = stage.write(_across(_open(shared, labels, stage, 2), classes, sets, stage, rule), "links-2")
    labels = _joined(labels, links, stage, 3)
    final = member.select(F.col("doc_id").alias("op8_doc"), "id").join(labels, "id", "left").select("op8_doc", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("op8_doc"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _joined(labels: DataFrame, links: DataFrame, stage: Stage, i: int) -> DataFrame:
    """``labels`` (id, component) after the links (a, b) between ids; a component is one node."""
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    found = components(edges, stage, f"c{i}").select(F.col("node").alias("component"), F.col("component").alias("least"))
    return stage.write(labels.join(found, "component", "left").select("id", F.coalesce("least", "component").alias("component")), f"labels-{i}")


def _open(shared: DataFrame, labels: DataFrame, stage: Stage, i: int) -> DataFrame:
    """(key, component, head) of buckets that hold several components; head is its least class in the bucket."""
    placed = stage.write(shared.select("key", "id").join(labels, "id").groupBy("key", "component").agg(F.min("id").alias("head")), f"placed-{i}")
    mixed = placed.groupBy("key").agg(F.count("*").alias("parts"), F.min("component").alias("lead"), F.max("head").alias("last")).filter("parts > 1")
    return stage.write(placed.join(mixed.select("key", "lead", "last"), "key"), f"open-{i}")


def _heads(open_: DataFrame) -> DataFrame:
    """Pairs of the smallest members of a bucket's components, each against that of the last."""
    return open_.filter("head <> last").select(F.least("head", "last").alias("a"), F.greatest("head", "last").alias("b")).distinct()


def _across(open_: DataFrame, classes: DataFrame, sets: DataFrame, stage: Stage, rule: Rule) -> DataFrame:
    """The links (a, b) between components of all classes that share a bucket with another component.

    Components that buckets connect are a family. The classes of a family are cut into blocks
    and each pair of blocks is compared once, in a task. Only links leave the task, never pairs.
    """
    labels = stage.read("labels-2")
    edges = open_.filter("component <> lead").select(F.col("component").alias("a"), F.col("lead").alias("b")).distinct()
    families = components(edges, stage, "families").select(F.col("node").alias("component"), F.col("component").alias("family"))
    own = labels.join(families, "component").join(classes.select("id", "n"), "id")
    sizes = own.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = own.drop("n").join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.concat_ws("/", "family", F.least("own", "other"), F.greatest("own", "other"))
    met = dealt.select(cell.alias("cell"), (F.col("own") <= F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"), "id", "component")
    full = met.join(classes, "id").join(sets, "id").select("cell", "side", "same", "id", "component", "n", "regs", "hashes")

    def run(batches):
        import pyarrow as pa

        rows = (r for t in batches for r in zip(*(c.to_pylist() for c in t.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            same = group[0][2]
            x = [r for r in group if same or r[1]]
            y = x if same else [r for r in group if not r[1]]
            links = list(_links(x, y, same, rule)) if x and y else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in links], pa.int64()), pa.array([max(p) for p in links], pa.int64())], names=["a", "b"])

    return full.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _links(x: list[tuple], y: list[tuple], same: bool, rule: Rule) -> Iterator[tuple[int, int]]:
    """Links of two blocks of (cell, side, same, id, component, n, regs, hashes) rows, of different components."""
    comp, n = np.array([r[4] for r in y]), np.array([r[5] for r in y])
    regs = np.frombuffer(b"".join(r[6] for r in y), dtype="<u2").reshape(-1, M)
    likely = np.zeros((len(x), len(y)), dtype=bool)
    for i, r in enumerate(x):
        possible = (comp != r[4]) & (rule.denominator * np.minimum(n, r[5]) >= rule.numerator * np.maximum(n, r[5]))
        if same:
            possible[: i + 1] = False
        at = np.flatnonzero(possible)
        if len(at):
            own = np.frombuffer(r[6], dtype="<u2")[None, :]
            likely[i, at] = at_least(rule.least, own, regs[at], np.full(len(at), r[5]), n[at])
    a, b = np.flatnonzero(likely.any(axis=1)).tolist(), np.flatnonzero(likely.any(axis=0)).tolist()
    if not a:
        return
    common = _common([np.frombuffer(x[i][7], dtype="<u8") for i in a], [np.frombuffer(y[j][7], dtype="<u8") for j in b])
    union = np.array([x[i][5] for i in a])[:, None] + n[b][None, :] - common
    for i, j in np.argwhere(likely[np.ix_(a, b)] & (rule.denominator * common >= rule.numerator * union)).tolist():
        yield x[a[i]][3], y[b[j]][3]


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of x with those of y, as products of 0-1 matrices."""
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def cells(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        column = np.searchsorted(both, flat)
        held = column < len(both)
        held[held] = both[column[held]] == flat[held]
        row, column = row[held], column[held]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    total, sides = np.zeros((len(x), len(y)), dtype=np.float32), [(len(x), *cells(x)), (len(y), *cells(y))]
    for start in range(0, len(both), COLUMNS):
        made = []
        for n, row, column in sides:
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            dense = np.zeros((n, COLUMNS), dtype=np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            made.append(dense)
        total += made[0] @ made[1].T
    return total.astype(np.int64)


def near_dup_digest(docs: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``docs``."""
    return link(docs, Stage(docs.sparkSession, "op8"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """``docs`` with one document of each component: the smallest doc_id.

    Rows without doc_id stay, and so do all rows of a repeated doc_id that is kept. Null and
    empty texts stay: they are linked with nothing. All columns are those of ``docs``.
    """
    stage = Stage(docs.sparkSession, "neardup")
    kept = link(docs, stage, rule).filter("kept and doc_id is not null").select(F.col("doc_id").alias("op8_kept")).distinct()
    kept_docs = docs.join(kept, F.col("doc_id") == F.col("op8_kept"), "left_semi")
    return without(kept_docs.unionByName(docs.filter("doc_id is null")))
