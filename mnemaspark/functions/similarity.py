"""Set and vector similarities, and the exact set-similarity self-join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import signatures
from .text import recall_tokens


def jaccard(a: Column, b: Column) -> Column:
    """F4 on arrays of distinct values: 0 if either is empty.

    No case stands around the common values, so that they are counted once.
    """
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.lit(1), F.size(a) + F.size(b) - both)


def containment(query: Column, of: Column) -> Column:
    """the share of ``query`` that ``of`` has."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, of)) / F.size(query))


def memory_tokens() -> Column:
    """Tokens of what, why and how together."""
    return F.array_union(F.array_union(recall_tokens(F.col("what")), recall_tokens(F.col("why"))), recall_tokens(F.col("how")))


def matches_text(query: Column) -> Column:
    """F9."""
    return jaccard(recall_tokens(query), memory_tokens())


def cosine(a: Column, b: Column) -> Column:
    """F27 in double precision; 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def hashed(rows: DataFrame, tokens: str) -> DataFrame:
    """(id, toks): 64-bit hashes of a row's tokens."""
    return rows.select("id", F.transform(tokens, lambda t: F.xxhash64(t)).alias("toks"))


def sketches(single: DataFrame) -> DataFrame:
    """(id, n, sketch) of rows (id, tok), see ``signatures.sketches``."""
    return signatures.sketches(hashed(single.groupBy("id").agg(F.collect_set("tok").alias("toks")), "toks"))


def similar_pairs(rows: DataFrame, key: list[str], tokens: str, threshold: float, strict: bool = False, large: bool = False) -> DataFrame:
    """(a, b, sim): ids with a < b of rows equal in ``key`` whose token sets are at least (or over) ``threshold`` similar.

    Prefix filtering: with tokens ordered from rare to frequent, two sets that similar share one
    of the first n - ceil(t n) + 1 of each. Only those are joined, so the rarest tokens make the
    candidates; lengths rule out more, and so does the place of the first common token, as the
    rest must hold enough others. ``large`` sets (with no key, ids long, no line breaks in tokens)
    meet by signatures of several tokens instead, see ``signatures``, and by sketches before they
    meet whole; steps are written so that shuffle files go. What is left is verified exactly.
    """
    own = rows.select("id", *key, F.col(tokens).alias("toks")).filter(F.size("toks") > 0)
    if large:
        sim = _large_similar(own, threshold)
    else:
        left, right = own.select(F.col("id").alias("a"), F.col("toks").alias("ta")), own.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
        sim = _candidates(own, key, threshold).join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("sim"))
    return sim.filter(F.col("sim") > threshold if strict else F.col("sim") >= threshold)


def _candidates(own: DataFrame, key: list[str], threshold: float) -> DataFrame:
    single = own.select("id", F.explode("toks").alias("tok"))
    freq = single.groupBy("tok").agg(F.count("*").alias("df"))
    ordered = single.join(freq, "tok").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("ranked"))
    prefix = ordered.withColumn("n", F.size("ranked")).select("id", "n", F.posexplode(F.slice("ranked", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))).alias("i", "r"))
    prefix = prefix.select("id", "n", "i", F.col("r.tok").alias("tok"))
    keyed = prefix.join(own.select("id", *key), "id") if key else prefix
    a, b = (keyed.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("i").alias(f"i{x}"), "tok", *key) for x in "ab")
    both = F.col("na") + F.col("nb")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    near &= F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= both * (threshold / (1 + threshold)) - 1e-9
    return a.join(b, ["tok", *key]).filter(near).select("a", "b").distinct()


def _large_similar(own: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of all pairs of rows (id, toks) that are similar, and of some that are not."""
    n, total = own.agg(F.count("*"), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
    tokens = hashed(own, "toks")
    met = written(signatures.candidates(tokens, threshold, n, total), "met")
    sketch = written(signatures.sketches(tokens), "sketches")
    for x in "ab":
        met = met.join(sketch.withColumnsRenamed({"id": x, "sketch": f"k{x}", "n": f"n{x}"}), x)
    differ = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    most = (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    pairs = written(met.filter(differ <= most).select("a", "b"), "pairs")
    return written(signatures.similarities(pairs, own.select("id", F.array_join("toks", "\n").alias("lines")), total), "similar")


def prefix_size(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places (at least one) by its exact binary value, ties to even; other roundings go by the shortest decimal that names it."""
    whole, unit, scale = F.floor(x), 1 << 60, 10**places
    scaled = (x - whole) * float(unit)
    part = scaled.cast("bigint").cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    low = F.floor(part / F.lit(unit).cast("decimal(20,0)")).cast("bigint")
    rest = part - low.cast("decimal(20,0)") * F.lit(unit).cast("decimal(20,0)")
    half = F.lit(unit // 2).cast("decimal(20,0)")
    up = F.when((rest > half) | ((rest == half) & ((low % 2 == 1) | (scaled > F.floor(scaled)))), 1).otherwise(0)
    return (whole * scale + low + up).cast("double") / scale
