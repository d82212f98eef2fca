"""Evaluation of recall and validation over labelled scenarios, each a namespace of its own.

All scenarios are one job: recall joins inside namespaces, candidate writes meet the memories of
their scenario, and figures are rolled up question by question, scenario by scenario, and over all
by macro means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import rounded
from ..sources.store import normalised
from . import intent, recall, validate

FACT = "who array<string>, what string, why string, `where` string, how string, importance double"
SCENARIO = (
    f"scenario string, description string, language string, memories array<struct<{FACT}>>, queries array<struct<query string, relevant_who array<string>>>, "
    "candidate_writes_contradicting array<struct<who array<string>, what string, `where` string, should_block boolean, reason string>>"
)
K, MAX_TOKENS = 5, 200


def _facts(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (namespace, seq, r) as normalised memories with ids of their own."""
    has = set(rows.schema["r"].dataType.names)
    text = lambda name: F.coalesce(F.col(f"r.`{name}`"), F.lit("")) if name in has else F.lit("")
    importance = F.coalesce("r.importance", F.lit(0.5)) if "importance" in has else F.lit(0.5)
    own = rows.select(
        "namespace", "seq", F.concat_ws("/", "namespace", F.lit(kind), F.col("seq").cast("string")).alias("id"), F.col("r.who").alias("who"), F.col("r.what").alias("what"), text("why").alias("why"),
        text("where").alias("place"), text("how").alias("how"), importance.alias("importance"), F.lit(None).cast("timestamp_ntz").alias("when_ts"), F.lit(None).cast("string").alias("consolidated_into"),
        *(["r.should_block"] if "should_block" in has else []), "lang")
    return normalised(own).filter("valid").drop("valid")


def scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, questions, candidates) of all scenario files at ``path``, in the order of each file.

    A question's language is the first two letters of its scenario's, pt where it has none.
    Facts without content or with an importance outside 0 to 1 are refused, as in any write.
    """
    files = spark.read.schema(SCENARIO).json(path, multiLine=True).withColumn("lang", F.substring(F.coalesce("language", F.lit("pt")), 1, 2)).withColumnRenamed("scenario", "namespace")
    each = lambda name: files.select("namespace", "lang", F.posexplode(name).alias("seq", "r")).withColumn("seq", F.col("seq").cast("long"))
    questions = each("queries").select("namespace", F.concat_ws("/", "namespace", F.col("seq").cast("string")).alias("query_id"), "seq", F.col("r.query").alias("question"), "lang", F.coalesce("r.relevant_who", F.array().cast("array<string>")).alias("relevant_who"))
    return _facts(each("memories"), "m"), questions, _facts(each("candidate_writes_contradicting"), "c")


def _relevant(who: str) -> Column:
    """Whether any participant of ``who`` is one of the question's, whatever the case."""
    low = lambda c: F.transform(c, F.lower)
    return F.arrays_overlap(low("relevant_who"), low(F.coalesce(F.col(who), F.array().cast("array<string>"))))


def _baseline(memories: DataFrame) -> DataFrame:
    """F32: (namespace, n_memories, base_tokens): all memories of a scenario listed, a line each."""
    who = F.when(F.size("who") > 0, F.concat_ws(",", "who")).otherwise("?")
    line = F.concat(F.lit("["), who, F.lit("] "), "what", F.when(~F.col("place").isin("", "default"), F.concat(F.lit(" @ "), "place")).otherwise(""))
    # as many line breaks as lines but one
    return memories.groupBy("namespace").agg(F.count("*").alias("n_memories"), F.floor((F.sum(F.length(line)) + F.count("*") - 1) / 4).alias("base_tokens"))


def by_question(memories: DataFrame, questions: DataFrame, k: int = K, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A row for each question: tokens and precision at ``k`` of what recall packs, beside those of listing all memories.

    The baseline's precision counts all relevant memories over min(k, memories), so it may exceed 1.
    A question that recalls nothing has no tokens and a precision of 0.
    """
    asked = intent.with_intent(questions)
    live = memories.filter("consolidated_into is null").select("id")
    found = recall.tiered(asked, memories, k).join(live, "id", "left_semi")
    tokens = recall.pack(found, asked, max_tokens).select("query_id", "tokens")
    wanted = questions.select("query_id", "namespace", "relevant_who")
    top = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = found.select("query_id", "rank", "who").withColumn("nth", top).filter(F.col("nth") <= k).join(wanted, "query_id").groupBy("query_id").agg(F.avg(_relevant("who").cast("double")).alias("precision"))
    # a participant asked for meets the memories that have it: no question sees all
    names = lambda rows, who, *more: rows.select("namespace", *more, F.explode(F.array_distinct(F.transform(who, F.lower))).alias("name"))
    relevant = names(wanted, "relevant_who", "query_id").join(names(memories, "who", "id"), ["namespace", "name"]).groupBy("query_id").agg(F.count_distinct("id").alias("relevant"))
    rows = questions.select("namespace", "query_id", "question").join(_baseline(memories), "namespace").join(tokens, "query_id", "left").join(hits, "query_id", "left").join(relevant, "query_id", "left")
    return rows.select(
        "namespace", "query_id", "question", "n_memories", "base_tokens", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        (F.coalesce("relevant", F.lit(0)) / F.least(F.lit(k), "n_memories")).alias("base_precision"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def detections(memories: DataFrame, candidates: DataFrame) -> DataFrame:
    """(namespace, tp, fn, fp, tn) of candidate writes (with should_block), each against the memories of its scenario alone.

    A warning counts as a detection. Reasons are not looked at.
    """
    # scenarios are kept apart by the place, which pairs must share
    apart = lambda rows: rows.withColumns({"place": F.concat_ws("\x01", "namespace", "place"), "why": F.lit("")})
    # all memories come before any candidate
    old, new = apart(memories).withColumn("seq", F.col("seq") - (1 << 40)), apart(candidates)
    # entities play no part here
    none = memories.sparkSession.createDataFrame([], "id string, name string")
    status = validate.validate(new, old, none).select("id", (F.col("status") != "OK").alias("caught"))
    both = candidates.select("id", "namespace", F.coalesce("should_block", F.lit(False)).alias("wanted")).join(status, "id")
    count = lambda test: F.count_if(test)
    w, c = F.col("wanted"), F.col("caught")
    return both.groupBy("namespace").agg(count(w & c).alias("tp"), count(w & ~c).alias("fn"), count(~w & c).alias("fp"), count(~w & ~c).alias("tn"))


def by_scenario(questions: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each scenario of ``by_question`` and ``detections``; percentages to one place, precisions to three, half-even."""
    base = questions.groupBy("namespace").agg(
        F.first("n_memories").alias("n_memories"), F.count("*").alias("n_queries"), F.sum("base_tokens").alias("base_tokens"), F.sum("tokens").alias("tokens"),
        rounded(F.avg("base_precision"), 3).alias("base_precision"), rounded(F.avg("precision"), 3).alias("precision"))
    saved = F.when(F.col("base_tokens") > 0, (F.col("base_tokens") - F.col("tokens")) / F.col("base_tokens") * 100).otherwise(0.0)
    rows = base.join(found, "namespace", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("tp", "fn", "fp", "tn")})
    return rows.withColumns({"savings_pct": rounded(saved, 1), "detection_pct": rounded(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")) * 100, 1)})


def overall(summaries: DataFrame) -> DataFrame:
    """One row of macro means: each scenario counts alike, by its rounded figures."""
    mean = lambda name, places: rounded(F.avg(name), places).alias(name)
    return summaries.agg(F.count("*").alias("n_scenarios"), mean("savings_pct", 1), mean("base_precision", 3), mean("precision", 3), mean("detection_pct", 1))


def write_results(questions: DataFrame, summaries: DataFrame, path: str) -> None:
    """JSON lines of both levels and the means, in folders of their own under ``path``."""
    for name, rows in (("questions", questions), ("scenarios", summaries), ("overall", overall(summaries))):
        rows.write.mode("overwrite").json(f"{path}/{name}")
