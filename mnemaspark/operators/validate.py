"""Validation of writes against what was written before: ambiguity, redundancy, contradiction.

A write is compared with earlier ones of equal place that share a participant, or where either
has none. Equal pairs meet by an equi-join on (place, participant); only rows without
participants meet all of their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine, jaccard
from ..functions.text import has_negation, stripped, validator_tokens
from ..sources.shared import ensure_checkpoint_dir

SIMILAR, WHO_OVERLAP, WHAT_OVERLAP = 0.85, 0.5, 0.3
#: How many contradictions that hang together one task settles.
TOGETHER = 50_000
#: Vectors less alike than this say the opposite, where words and participants say the same.
UNLIKE = 0.4
PREPARED = ("id", "seq", "who", "what", "why", "place")


def _prepared(memories: DataFrame) -> DataFrame:
    who = F.array_distinct(F.coalesce("who", F.array().cast("array<string>")))
    more = ["vid"] if "vid" in memories.columns else []
    return memories.select("id", "seq", *more, who.alias("who"), F.coalesce(F.nullif("place", F.lit("")), F.lit("default")).alias("place"),
                           validator_tokens(F.col("what")).alias("toks"), (has_negation(F.col("what")) | has_negation(F.col("why"))).alias("neg"))


def overlapping(new: DataFrame, old: DataFrame, named_only: bool = False) -> DataFrame:
    """Pairs of a write and an earlier memory, with overlaps and whether one is negated.

    ``named_only`` leaves out pairs without a common participant, which can't contradict each other.
    """
    a, b = _prepared(new), _prepared(old)
    has = "vid" in a.columns and "vid" in b.columns
    names = {"id": "", "seq": "s", "who": "w", "toks": "t", "neg": "n", **({"vid": "v"} if has else {})}
    x, y = (rows.select("place", *[F.col(n).alias(short + tag) for n, short in names.items()]) for rows, tag in ((a, "a"), (b, "b")))
    # rows bring along what is compared; of several common participants only the least brings a pair together
    some = x.select("*", F.explode("wa").alias("w")).join(y.select("*", F.explode("wb").alias("w")), ["place", "w"]).filter("sb < sa and a <> b and (size(wa) = 1 or size(wb) = 1 or w = array_min(array_intersect(wa, wb)))").drop("w")
    pairs = some if named_only else some.unionByName(x.filter("size(wa) = 0").join(y, "place").unionByName(x.filter("size(wa) > 0").join(y.filter("size(wb) = 0"), "place")).filter("sb < sa"))
    return pairs.select(
        "a", "b", "sa", "sb", *(["va", "vb"] if has else []), jaccard(F.col("wa"), F.col("wb")).alias("who_overlap"), jaccard(F.col("ta"), F.col("tb")).alias("what_overlap"), (F.col("na") != F.col("nb")).alias("opposed"))


def ambiguous(memories: DataFrame, entities: DataFrame, name: str = "who") -> DataFrame:
    """(id, n_candidates) of memories of which a participant's name is that of several entities."""
    return _homonyms(memories, entities, name).groupBy("id").agg(F.sum("n").alias("n_candidates"))


def candidates(memories: DataFrame, entities: DataFrame, name: str = "who") -> DataFrame:
    """(id, ambiguous_ids): the entities that the names may mean, in order of the participants, then of the ids."""
    named = _homonyms(memories, entities, name).select("id", "at", "w")
    each = named.join(entities.select(F.lower("name").alias("w"), F.col("id").alias("entity")), "w")
    return each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "entity"))).alias("e")).select("id", F.col("e.entity").alias("ambiguous_ids"))


def _homonyms(memories: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    names = memories.select("id", F.posexplode(name).alias("at", "w")).select("id", "at", F.lower("w").alias("w"))
    known = entities.groupBy(F.lower("name").alias("w")).agg(F.count("*").alias("n")).filter("n > 1")
    return names.join(known, "w")


def _conflict():
    return (F.col("who_overlap") >= WHO_OVERLAP) & (F.col("what_overlap") >= WHAT_OVERLAP) & F.col("opposed")


def digest(vector: str = "vector") -> Column:
    """16 bytes that stand for a vector: equal vectors are one."""
    return F.unhex(F.md5(F.to_json(F.struct(vector))))


def compared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """V3: ``pairs`` (with va and vb, digests of vectors) with ``unlike``: same participants and words, no denial, but vectors that are less than UNLIKE alike.

    Only such pairs meet the vectors (vid, vector; one row each), and each two vectors once. A pair of which one has none, or is of another length, is taken for alike.
    """
    asks = (F.col("who_overlap") >= WHO_OVERLAP) & (F.col("what_overlap") >= WHAT_OVERLAP) & ~F.col("opposed")
    x, y = (vectors.select(F.col("vid").alias(f"v{n}"), F.col("vector").alias(f"vector_{n}")) for n in "ab")
    near = F.when(F.size("vector_a") == F.size("vector_b"), cosine(F.col("vector_a"), F.col("vector_b")))
    far = pairs.filter(asks).select("va", "vb").distinct().join(x, "va").join(y, "vb").filter(near < UNLIKE).select("va", "vb", F.lit(True).alias("far"))
    return pairs.join(far, ["va", "vb"], "left").withColumn("unlike", asks & F.coalesce("far", F.lit(False))).drop("far")


def judged(pairs: DataFrame) -> DataFrame:
    """(id, similar_id, similarity, conflict_id, and of the conflict both overlaps and whether by vectors): the most similar earlier memory over the limit and the first that contradicts; rows for writes that have either.

    Pairs are summed up by write and similarity first: of equal ones only the first counts. Sums
    are filtered, not pairs, whose overlaps would be counted again in the join for each test.
    """
    by_vector = F.col("unlike") if "unlike" in pairs.columns else F.lit(False)
    conflict, near = _conflict() | by_vector, F.col("what_overlap") >= SIMILAR
    told = {"conflict_id": F.col("b"), "who_overlap": F.col("who_overlap"), "what_overlap": F.col("what_overlap"), "by_vector": by_vector & ~F.col("opposed")}
    first = lambda value, at, when: F.min_by(F.when(when, value), F.when(when, at))
    levels = pairs.groupBy("a", F.when(near, F.col("what_overlap")).alias("level")).agg(
        F.min("sb").alias("sb"), F.min_by("b", "sb").alias("b"), F.min(F.when(conflict, F.col("sb"))).alias("stop"), *[first(x, F.col("sb"), conflict).alias(n) for n, x in told.items()]).filter("level is not null or stop is not null")
    each = levels.groupBy(F.col("a").alias("id")).agg(
        F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", (-F.col("sb")).alias("back"), "b"))).alias("near"), F.min("stop").alias("until"), *[F.min_by(n, "stop").alias(n) for n in told])
    # redundancy is looked for up to the first conflict only
    best = F.array_max(F.filter("near", lambda r: F.col("until").isNull() | (-r["back"] <= F.col("until"))))
    return each.withColumn("best", best).select("id", F.col("best.b").alias("similar_id"), F.col("best.level").alias("similarity"), *told)


def validate(new: DataFrame, old: DataFrame, entities: DataFrame, policy: str = "WARN", vectors: DataFrame | None = None, explain: bool = False) -> DataFrame:
    """V1 and V2: (id, status, level, conflict_id, similar_id, downgraded_from) of every write.

    With ``vectors`` (id, vector, of new and old) V3 as well, whose conflicts have the level
    embedding. With ``explain`` also overlaps, similarity and the ids of ambiguous entities.
    """
    if vectors is None:
        pairs = overlapping(new, old)
    else:
        marked = vectors.withColumn("vid", digest())
        known = lambda rows: rows.join(marked.select("id", "vid"), "id", "left")
        pairs = compared(overlapping(known(new), known(old)), marked.groupBy("vid").agg(F.first("vector").alias("vector")))
    found = new.select("id", "what", "when_ts").join(judged(pairs), "id", "left").join(ambiguous(new, entities), "id", "left")
    level = (
        F.when(stripped(F.col("what")) == "", "schema").when(F.col("by_vector"), "embedding").when(F.col("conflict_id").isNotNull(), "contradiction").when(F.col("similar_id").isNotNull(), "redundancy")
        .when(F.col("n_candidates").isNotNull(), "ambiguity").when(F.year("when_ts") > 2200, "date").otherwise("none"))
    status = F.when(level == "none", "OK").when(level.isin("schema", "contradiction", "embedding"), "WARN" if policy == "WARN" else "BLOCKED").otherwise("WARN")
    downgraded = F.when(level.isin("schema", "contradiction", "embedding") & F.lit(policy == "WARN"), "BLOCKED")
    more = ["who_overlap", "what_overlap", "similarity", "ambiguous_ids"] if explain else []
    if explain:
        found = found.join(candidates(new, entities), "id", "left")
    return found.select("id", status.alias("status"), level.alias("level"), "conflict_id", "similar_id", downgraded.alias("downgraded_from"), *more)


def unvalidated(rows: DataFrame) -> DataFrame:
    """Result rows of writes that were not judged."""
    kind = dict(rows.dtypes)["id"]
    return rows.select("id", *[F.lit(None).cast(t).alias(n) for n, t in (("status", "string"), ("level", "string"), ("conflict_id", kind), ("similar_id", kind), ("downgraded_from", "string"))])


def validator_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "WARN", "BLOCKED")])


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each node of ``edges`` (a, b) is connected with.

    Each round takes the least root among neighbours, then the root's own, so a chain halves.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    roots = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")).checkpoint()
    while True:
        near = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("m"))
        least = roots.join(near, "id").select("id", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jumped = least.join(least.select(F.col("id").alias("root"), F.col("root").alias("next")), "root").select("id", "was", F.least("root", "next").alias("root")).checkpoint()
        roots = jumped.select("id", "root")
        if jumped.filter("root <> was").isEmpty():
            return roots


def accept_in_order(writes: DataFrame, old: DataFrame | None = None, together: int = TOGETHER) -> DataFrame:
    """BLOCK policy: (id, accepted) where a write is compared only with ``old`` and with accepted writes before it.

    A blank write is refused. Contradictions are the edges of a graph. A connected part of up to
    ``together`` edges is settled by one task, write after write. Larger ones go by rounds: each
    refuses the writes next to one accepted before them and accepts those of which all earlier
    neighbours are refused, so no place or participant is brought together in one task.
    """
    ensure_checkpoint_dir(writes.sparkSession)
    fit = writes.filter(stripped(F.col("what")) != "")
    before = fit if old is None else old.select(*PREPARED).unionByName(fit.select(*PREPARED))
    edges = overlapping(fit, before, named_only=True).filter(_conflict()).select("a", "b", "sa").checkpoint()
    of = edges.join(components(edges).withColumnRenamed("id", "a"), "a").checkpoint()
    large = of.groupBy("root").count().filter(F.col("count") > together).select("root").checkpoint()
    kind = dict(edges.dtypes)["a"]

    def settle(batches):
        import pyarrow as pa

        part, refused, ids, flags = None, {}, [], []
        for batch in batches:
            for root, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if root != part:
                    ids += refused
                    flags += refused.values()
                    part, refused = root, {}
                # whatever is no one's later part has been accepted
                refused[a] = refused.get(a, False) or not refused.get(b, False)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(1).type), pa.array([not r for r in flags], type=pa.bool_())], names=["id", "accepted"])
            ids, flags, last = [], [], batch.schema.field(1).type
        if refused:
            yield pa.RecordBatch.from_arrays([pa.array(refused, type=last), pa.array([not r for r in refused.values()], type=pa.bool_())], names=["id", "accepted"])

    small = of.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "sa", "a").select("root", "a", "b")
    settled = [small.mapInArrow(settle, f"id {kind}, accepted boolean").checkpoint()]
    todo = of.join(large, "root", "left_semi").select(F.col("a").alias("id")).distinct().checkpoint()
    wide = of.join(large, "root", "left_semi").select("a", "b").checkpoint()
    # in large parts: nodes that are no write with an earlier contradiction
    known = wide.select(F.col("b").alias("id")).distinct().join(todo, "id", "left_anti").select("id", F.lit(True).alias("accepted")).checkpoint()
    while not todo.isEmpty():
        seen = wide.join(todo.withColumnRenamed("id", "a"), "a").join(known.withColumnRenamed("id", "b"), "b", "left")
        ruled = seen.groupBy(F.col("a").alias("id")).agg(F.bool_or(F.coalesce("accepted", F.lit(False))).alias("refused"), F.bool_or(F.col("accepted").isNull()).alias("open"))
        done = ruled.filter("refused or not open").select("id", (~F.col("refused")).alias("accepted")).checkpoint()
        settled.append(done)
        known = known.unionByName(done)
        todo = todo.join(done, "id", "left_anti").checkpoint()
    state = reduce(DataFrame.unionByName, settled)
    blank = stripped(F.col("what")) == ""
    return writes.select("id", blank.alias("blank")).join(state, "id", "left").select("id", (~F.col("blank") & F.coalesce("accepted", F.lit(True))).alias("accepted"))


def validate_in_order(writes: DataFrame, old: DataFrame, entities: DataFrame, policy: str = "WARN") -> tuple[DataFrame, DataFrame]:
    """(results, writes to store) of writes that come one after another: what was blocked is never compared with."""
    ensure_checkpoint_dir(writes.sparkSession)
    after = follow(writes, old)
    taken = after
    if policy != "WARN":
        taken = after.join(accept_in_order(after, old).filter("accepted").select("id"), "id", "left_semi").select(*after.columns)
    results = validate(after, old.select(*PREPARED).unionByName(taken.select(*PREPARED)), entities, policy).checkpoint()
    # written, so that the plans of later writes and questions don't grow with each call
    return results, after.join(results.filter("status <> 'BLOCKED'").select("id"), "id", "left_semi").select(*writes.columns).checkpoint()


def follow(writes: DataFrame, old: DataFrame) -> DataFrame:
    """``writes`` with ``seq`` moved behind that of all of ``old``: they came later, whatever numbers they bring."""
    last, first = old.agg(F.max("seq").alias("last")), writes.agg(F.min("seq").alias("first"))
    moved = writes.join(F.broadcast(last.join(first)))  # one row
    return moved.withColumn("seq", F.col("seq") + F.coalesce(F.col("last") + 1 - F.col("first"), F.lit(0))).select(*writes.columns)
