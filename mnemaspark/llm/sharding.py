"""Size-balanced sharding by sampled splitters.

Keys are sampled in proportion to the size of their rows, quantiles of that sample cut the
key space into ranges, and ranges that come out overfull are sampled again and subdivided.
Inside a range rows are ordered by key; exact totals of the ranges before it give every row
its position in the whole order, and the position gives the shard.

Only key, size and checksum travel: the text is read once and never shuffled. Rows equal in
all three are aggregated to one row with a count first, so that a key that holds a third of
the rows is one row to sort. What reaches the driver is the sample and a total per range,
both bounded by ``ranges`` and ``per_range``.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, without

SHARDS = 24
RANGES = 96
PER_RANGE = 32
ROUNDS = 6
OVERFULL = 2.0

Key = tuple[int, int, int]


def _order_key() -> Column:
    return F.struct(F.col("k"), F.col("crc"), F.col("size"))


def _literal(key: Key) -> Column:
    return F.struct(F.lit(key[0]).cast("long").alias("k"), F.lit(key[1]).cast("long").alias("crc"), F.lit(key[2]).cast("long").alias("size"))


def _with_range(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """rng: how many splitters lie below the row's key, found in two levels of about sqrt(n) each."""
    if not splitters:
        return rows.withColumn("rng", F.lit(0))
    below = lambda keys: F.size(F.filter(F.array(*map(_literal, keys)), lambda s: s < _order_key()))
    step = max(1, int(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    rng = F.lit(len(splitters))
    for i in reversed(range(len(groups))):
        rng = F.when(F.col("top") == i, F.lit(i * step) + below(groups[i])).otherwise(rng)
    return rows.withColumn("top", below([g[-1] for g in groups])).withColumn("rng", rng.cast("int")).drop("top")


def _sample(rows: DataFrame, total: int, wanted: int, seed: int) -> list[tuple[Key, float]]:
    """About ``wanted`` keys, each drawn with a chance in proportion to its bytes; (key, weight)."""
    bytes_ = F.col("size") * F.col("copies")
    draw = F.pmod(F.xxhash64("k", "crc", "size", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    got = rows.filter(draw < bytes_ * F.lit(wanted / max(total, 1))).select("k", "crc", "size", F.greatest(bytes_.cast("double"), F.lit(total / wanted)).alias("w"))
    return sorted(((r["k"], r["crc"], r["size"]), r["w"]) for r in got.collect())


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    total, seen, cuts = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        seen += w
        if len(cuts) < parts - 1 and seen >= total * (len(cuts) + 1) / parts and (not cuts or key > cuts[-1]):
            cuts.append(key)
    return cuts


def _subdivided(splitters: list[Key], sample: list[tuple[Key, float]], parts: dict[int, int]) -> list[Key]:
    """``splitters`` with those that cut each range of ``parts`` into so many; ranges count in ``splitters`` as given."""
    own: dict[int, list[tuple[Key, float]]] = {r: [] for r in parts}
    for key, w in sample:
        if (r := bisect_left(splitters, key)) in own:
            own[r].append((key, w))
    return sorted({*splitters, *(cut for r, n in parts.items() for cut in _quantiles(own[r], n))})


def assign(digests: DataFrame, stage: Stage, shards: int = SHARDS, law: str = "bytes", ranges: int = RANGES, per_range: int = PER_RANGE, seed: int = 7) -> DataFrame:
    """Shard and slot of every row of ``digests`` (doc_id, size, crc).

    law ``bytes``: a shard takes the rows whose first byte lies in its equal part of all
    bytes, so shards differ by one row's size at most. law ``rows``: equal parts of the row
    count. Null doc_ids sort first; rows equal in all columns are interchangeable and each
    gets a slot of its own; an empty table gives an empty result.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law is bytes or rows, not {law!r}")
    rows = stage.write(
        digests.groupBy("doc_id", "size", "crc").agg(F.count("*").alias("copies"))
        .withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))),
        "rows",
    )
    total = rows.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    splitters = _quantiles(_sample(rows, total, ranges * per_range, seed), ranges)
    limit = OVERFULL * total / ranges
    for again in range(ROUNDS):
        placed = _with_range(rows, splitters)
        found = placed.groupBy("rng").agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n"), F.count("*").alias("keys")).collect()
        over = [r for r in found if r["b"] > limit and r["keys"] > per_range]
        if not over or again == ROUNDS - 1:
            break
        more = _sample(placed.filter(F.col("rng").isin([r["rng"] for r in over])), sum(r["b"] for r in over), per_range * 2 * len(over), seed + again + 1)
        splitters = _subdivided(splitters, more, {r["rng"]: 1 + int(r["b"] / max(limit, 1)) for r in over})
    before, b, n = {}, 0, 0
    for r in sorted(found, key=lambda r: r["rng"]):
        before[r["rng"]], b, n = (b, n), b + r["b"], n + r["n"]
    offsets = rows.sparkSession.createDataFrame([(i, *x) for i, x in before.items()], "rng int, b0 long, n0 long")
    # one row for each range: its count is bounded by the splitters above
    order = Window.partitionBy("rng").orderBy("k", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        placed.withColumn("b1", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0)))
        .withColumn("n1", F.coalesce(F.sum("copies").over(order), F.lit(0)))
        .join(F.broadcast(offsets), "rng")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("rank", F.col("n0") + F.col("n1") + F.col("copy"))
        .withColumn("at", F.col("b0") + F.col("b1") + F.col("copy") * F.col("size"))
    )
    place = F.expr(f"at * {shards} div {max(total, 1)}") if law == "bytes" else F.expr(f"rank * {shards} div {max(n, 1)}")
    ranked = stage.write(ranked.select("doc_id", "size", "crc", "copy", "rank", F.least(place, F.lit(shards - 1)).cast("int").alias("shard")), "ranked")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "crc", "copy", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("crc"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes") -> None:
    """Write ``docs`` under ``path``, a folder for each shard, rows in slot order inside its files.

    All columns of ``docs`` are written, but those named shard or slot are replaced. Null texts
    stay null; rows without doc_id come first; rows equal in doc_id, size and checksum take the slots
    of their copies in any order; an empty table writes none.
    """
    stage = Stage(docs.sparkSession, "shards")
    placed = assign(digest(docs), stage, shards, law)
    body = F.coalesce(F.col("text"), F.lit(""))
    # the row travels whole, so that none of its names meets those added here
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in without(docs, "shard", "slot").columns]).alias("row"), "doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    own = Window.partitionBy("doc_id", "size", "crc").orderBy(F.lit(0))
    keyed = keyed.withColumn("copy", (F.row_number().over(own) - 1).cast("long"))
    joined = keyed.alias("a").join(placed.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.size = b.size and a.crc = b.crc and a.copy = b.copy"))
    out = joined.select("a.row.*", "b.shard", "b.slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    stage.drop()


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest result: one row for each row of ``docs``."""
    placed = assign(digest(docs), Stage(docs.sparkSession, "op10"), shards)
    return placed.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
