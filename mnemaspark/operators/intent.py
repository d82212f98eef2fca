"""Questions to intents: an ordered list of patterns for each language, as one expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions.text import detect_lang, stripped
from ..sources.shared import ensure_checkpoint_dir

INTENT = "who array<string>, what string, where string, query_type string, confidence double"


def groups(pattern: str) -> int:
    return re.compile(pattern).groups


#: All patterns, the languages' lists one after another; an intent is known by its pattern's place here.
PATTERNS = [(code, pattern, kind) for code in ("en", "es", "pt") for pattern, kind in L.QUESTIONS[code]]


def _number(q: Column, lang: Column) -> Column:
    """The first pattern of the language that a question meets, or null; those of pt stand in for languages that have none."""
    found: dict[str, Column] = {}
    for i, (code, pattern, _) in enumerate(PATTERNS):
        hit = q.rlike(L.unicode_words(pattern))
        found[code] = found[code].when(hit, i) if code in found else F.when(hit, i)
    return F.when(q != "", F.when(lang == "en", found["en"]).when(lang == "es", found["es"]).otherwise(found["pt"]))


def _with_slots(rows: DataFrame) -> DataFrame:
    """Columns kind, one, two and place_only of each row's pattern ``n`` over its text ``q``."""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("n"))
    # two empty groups at the end, so that every pattern has a first and a second
    pattern = pick([L.unicode_words(p) + "()()" for _, p, _ in PATTERNS])
    part = lambda g: stripped(F.call_function("regexp_extract", "q", pattern, F.lit(g)))
    return rows.withColumns({
        "kind": F.coalesce(pick([k for *_, k in PATTERNS]), F.lit("unknown")), "one": part(1), "two": part(2),
        "place_only": F.coalesce(pick([k == "location" and groups(p) == 1 for _, p, k in PATTERNS]), F.lit(False)),
        "confidence": F.coalesce(pick([float(L.CONFIDENCE[k]) for *_, k in PATTERNS]), F.lit(0.0))})


def with_intent(questions: DataFrame) -> DataFrame:
    """``questions`` (query_id, question, lang: pt, en, es or auto) with ``intent``; lang becomes the one used.

    Each question meets each pattern once: the parsed questions are written to the shared
    folder, since all that follows reads them several times.
    """
    ensure_checkpoint_dir(questions.sparkSession)
    lang = F.when(F.col("lang") == "auto", detect_lang(F.col("question"))).otherwise(F.col("lang"))
    own = questions.select(F.struct(*questions.columns).alias("row"), lang.alias("lang"), stripped(F.lower("question")).alias("q"))
    read = _with_slots(own.withColumn("n", _number(F.col("q"), F.col("lang"))))
    kind, one, place_only = F.col("kind"), F.col("one"), F.col("place_only")
    who = F.when((kind == "temporal") | place_only, "").otherwise(one)
    what = F.when(kind == "temporal", one).when(kind.isin("action", "location", "temporal who", "causal"), F.col("two")).otherwise("")
    intent = F.struct(
        F.filter(F.array(who), lambda w: w != "").alias("who"), what.alias("what"), F.when(place_only, one).otherwise("").alias("where"),
        F.split_part(kind, F.lit(" "), F.lit(1)).alias("query_type"), "confidence")
    kept = [F.col("lang") if c == "lang" else F.col(f"row.{c}").alias(c) for c in questions.columns]
    return read.select(*kept, intent.alias("intent")).repartition("query_id").checkpoint()


def structured(i: str = "intent") -> Column:
    """Sure enough, and any of who, what or where is known."""
    return (F.col(f"{i}.confidence") >= 0.5) & ((F.size(f"{i}.who") > 0) | (F.col(f"{i}.what") != "") | (F.col(f"{i}.where") != ""))


def hybrid(rows: DataFrame, fallback, threshold: float = 0.5) -> DataFrame:
    """``fallback`` (a DataFrame -> DataFrame with the same columns) answers only where the patterns are unsure."""
    sure = F.col("intent.confidence") >= threshold
    return rows.filter(sure).unionByName(fallback(rows.filter(~sure)))


def by_model(model):
    """A fallback that asks ``model(prompt) -> str`` in batches; JSON with who, what and where gives 0.7, other text 0.5."""

    def fallback(rows: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def ask(q):
            def one(x):
                try:
                    return model(f"Extract who, what, where and query_type as JSON from: {x}")
                except Exception:
                    return ""

            return q.map(one)

        answer = F.regexp_extract("answer", r"\{[^{}]*\}", 0)
        parsed = F.from_json(answer, "who array<string>, what string, where string, query_type string")
        got = F.struct(
            F.coalesce(parsed["who"], F.array().cast("array<string>")).alias("who"), F.coalesce(parsed["what"], F.lit("")).alias("what"),
            F.coalesce(parsed["where"], F.lit("")).alias("where"), F.coalesce(parsed["query_type"], F.lit("general")).alias("query_type"),
            F.when(F.col("answer") == "", 0.0).when(parsed.isNull() | (answer == ""), 0.5).otherwise(0.7).alias("confidence"),
        )
        return rows.withColumn("answer", ask("question")).withColumn("intent", got).drop("answer")

    return fallback
