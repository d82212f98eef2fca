"""Free text to memories: what the text itself says, then what its nearest memory knows, then a model for texts without content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions.text import extract_when, extract_where, extract_who, stripped
from . import vector
from .dream import asked

ANSWER = "who array<string>, what string, why string, `when` string, `where` string, how string"


def heuristic(texts: DataFrame) -> DataFrame:
    """F16: (id, seq, who, what, why, when_text, place, how, lang, importance) of texts (id, seq, text)."""
    text = F.coalesce("text", F.lit(""))
    return texts.select(
        "id", "seq", extract_who(text).alias("who"), text.alias("what"), F.lit("").alias("why"), extract_when(text).alias("when_text"), extract_where(text).alias("place"), F.lit("").alias("how"),
        F.lit(None).cast("string").alias("lang"), F.lit(0.5).alias("importance"))


def with_nearest(rows: DataFrame, memories: DataFrame, vectors: DataFrame, known: DataFrame) -> DataFrame:
    """Place (where it is the default), language and 0.8 of the importance of each text's nearest memory.

    ``vectors`` (id, vector) are those of the texts, ``known`` those of the memories; ids are
    numbers. A text without a vector, or with no memory that is alike enough, stays as it is.
    """
    near = vector.top_k(known.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("embedding")), 1, own=True)
    ref = near.join(memories.select(F.col("id").alias("vec_id"), F.col("place").alias("_place"), F.col("lang").alias("_lang"), F.col("importance").alias("_importance")), "vec_id").select(F.col("query_id").alias("id"), F.lit(True).alias("_known"), "_place", "_lang", "_importance")
    got = rows.join(ref, "id", "left")
    return got.withColumns({
        "place": F.when(F.col("_known") & F.col("place").isin("", "default"), F.col("_place")).otherwise(F.col("place")), "lang": F.coalesce("lang", "_lang"),
        "importance": F.when(F.col("_known"), F.col("_importance") * 0.8).otherwise(F.col("importance"))}).select(*rows.columns)


def with_model(rows: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Texts without content are put to the model; the fields of the first flat JSON object in its answer that aren't empty are taken."""
    empty = stripped(F.col("what")) == ""
    ask = F.concat(F.lit("Read who, what, where, when, why and how from this text and answer with JSON only: "), F.col("what"))
    said = asked(rows.filter(empty).withColumn("prompt", ask), model).withColumn("said", F.from_json(F.regexp_extract("answer", r"\{[^{}]*\}", 0), ANSWER))
    take = lambda name, field: F.when(F.coalesce(F.col(f"said.{field}"), F.lit("")) != "", F.col(f"said.{field}")).otherwise(F.col(name))
    filled = said.withColumns({
        "who": F.when(F.size("said.who") > 0, F.col("said.who")).otherwise(F.col("who")), **{n: take(n, n) for n in ("what", "why", "how")}, "place": take("place", "where"), "when_text": take("when_text", "when")})
    return rows.filter(~empty).unionByName(filled.select(*rows.columns))


def extracted(texts: DataFrame, memories: DataFrame | None = None, load: Callable[[], embedding.Model] | None = None, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Texts as memories; with ``load`` (a vector model for workers) and memories the second level, with ``model`` the third."""
    rows = heuristic(texts)
    if load is not None and memories is not None:
        rows = with_nearest(rows, memories, embedding.encoded(texts, "id", "text", load), embedding.encoded(memories, "id", "what", load))
    return with_model(rows, model) if model is not None else rows
