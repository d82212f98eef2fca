"""A chat's memory as a stream: before each user turn what is remembered is recalled, after it the exchange is stored.

Conversations are namespaces of their own, or all share one. Batches come in order of arrival;
inside a batch the n-th exchanges of all conversations are one round, which recalls first, from all
that earlier batches and rounds stored, and then validates and stores. So each conversation sees
what a turn-by-turn run shows it, and rounds are as many as a conversation has exchanges in a batch.

An exchange is complete when its answer arrives, or the next user turn without one. A user turn
that is the last so far has its context recalled at once and waits for its answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..engine import Engine
from ..functions.text import extract_where, extract_who
from ..operators import intent, recall, validate

TURN = "conv_id long, turn long, role string, text string"
IMPORTANCE, CONTEXT_TOKENS = 0.6, 300
MEMORY = (
    "namespace string, id string, seq long, who array<string>, what string, why string, place string, how string, importance double, when_ts timestamp_ntz, created_at timestamp_ntz, "
    "access_count int, last_accessed timestamp_ntz, is_summary boolean, consolidated_from array<string>, consolidated_into string, lang string"
)
CONTEXT = "namespace string, conv_id long, turn long, context string, tokens int"


def exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text, answer, open): user turns with the assistant's next turn; ``open`` where nothing follows yet.

    Turns of other roles count for nothing. Null texts are empty; equal turns go by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"), "text")
    known = turns.filter("role in ('user', 'assistant')").withColumn("text", F.coalesce("text", F.lit("")))
    after = known.withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)}).filter("role = 'user'")
    return after.select("conv_id", "turn", "text", F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("answer"), F.col("next_role").isNull().alias("open"))


def memory_of(pairs: DataFrame, isolated: bool) -> DataFrame:
    """B2: exchanges as memories: what the user said, who and where it names, the answer as the way; a time it names is not used."""
    made = {
        "namespace": _space(isolated), "id": F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.col("turn").cast("string")), "seq": F.col("nth").cast("long"), "who": extract_who(F.col("text")), "what": F.col("text"),
        "why": F.lit(""), "place": extract_where(F.col("text")), "how": F.col("answer"), "importance": F.lit(IMPORTANCE), "when_ts": F.col("at"), "created_at": F.col("at"), "access_count": F.lit(0), "is_summary": F.lit(False),
        "consolidated_from": F.array().cast("array<string>")}
    return pairs.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(MEMORY).fields])


def _space(isolated: bool):
    return F.concat(F.lit("chat-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))) if isolated else F.lit("default")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    full = StructType([*StructType.fromDDL(schema).fields, StructField("stream", StringType()), StructField("batch", LongType())])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(full).parquet(path) if there else spark.createDataFrame([], full)


def _apart(rows: DataFrame) -> DataFrame:
    """Places made those of a namespace, so that validation compares inside it only."""
    return rows.withColumn("place", F.concat_ws("\x01", "namespace", "place"))


def context(asked: DataFrame, memories: DataFrame, max_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """B1: ``asked`` (namespace, conv_id, turn, text) with the context that recall packs for it, empty if nothing is found."""
    # namespaces hold a conversation or all of them: a question is known by both numbers
    questions = asked.select("namespace", F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("question"), F.lit("auto").alias("lang"))
    parsed = intent.with_intent(questions)
    found = recall.tiered(parsed, memories).join(memories.filter("consolidated_into is null").select("id"), "id", "left_semi")
    packed = recall.pack(found, parsed, max_tokens)
    return questions.select("namespace", "query_id").join(packed, "query_id", "left").select("namespace", "query_id.*", F.coalesce("packed", F.lit("")).alias("context"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def converse(stream: DataFrame, folder: str, checkpoint: str, at: str, policy: str = "WARN", isolated: bool = True, max_tokens: int = CONTEXT_TOKENS):
    """A started query over a stream of turns (TURN) that keeps ``folder``/memories and ``folder``/contexts.

    Both have a part for each batch, replaced if the batch runs again. ``at`` is the time given to what is stored.
    """
    spark, name = stream.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()

    def before(kind: str, schema: str, batch_id: int) -> DataFrame:
        return _table(spark, f"{folder}/{kind}", schema).filter((F.col("stream") != name) | (F.col("batch") < batch_id)).drop("stream", "batch")

    def put(rows: DataFrame, kind: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{kind}/stream={name}/batch={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        turns = batch.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(TURN).fields])
        waiting = _table(spark, f"{folder}/waiting", TURN).filter((F.col("stream") == name) & (F.col("batch") == batch_id - 1)).drop("stream", "batch")
        pairs = exchanges(waiting.unionByName(turns)).withColumns({"nth": F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")), "at": F.lit(at).cast("timestamp_ntz")}).checkpoint()
        known = waiting.select("conv_id", "turn").withColumn("known", F.lit(True))
        pairs = pairs.join(F.broadcast(pairs.agg(F.max("nth").alias("rounds"))), F.lit(True)).join(known.distinct(), ["conv_id", "turn"], "left")
        old, new, contexts = before("memories", MEMORY, batch_id), [], []
        nothing = spark.createDataFrame([], "id string, name string")
        for nth in range(1, (pairs.agg(F.max("rounds")).first()[0] or 0) + 1):
            own = pairs.filter(F.col("nth") == nth)
            now = old if not new else old.unionByName(_all(new))
            # a turn that waited had its context when it came
            contexts.append(context(own.filter("known is null").withColumn("namespace", _space(isolated)), now, max_tokens).checkpoint())
            made = memory_of(own.filter("not open"), isolated)
            _, stored = validate.validate_in_order(_apart(made), _apart(now), nothing, policy)
            kept = stored.withColumn("place", F.element_at(F.split("place", "\x01"), -1)).checkpoint()
            new.append(kept)
        put(_all(new) if new else old.limit(0), "memories", batch_id)
        put(_all(contexts) if contexts else spark.createDataFrame([], CONTEXT), "contexts", batch_id)
        put(pairs.filter("open").select("conv_id", "turn", F.lit("user").alias("role"), "text"), "waiting", batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def engine(spark: SparkSession, folder: str, policy: str = "WARN", namespace: str | None = None) -> Engine:
    """What the chats have stored, of one namespace or all, to inspect, ask about and count."""
    rows = _table(spark, f"{folder}/memories", MEMORY).drop("stream", "batch")
    own = rows if namespace is None else rows.filter(F.col("namespace") == namespace)
    return Engine(own, spark.createDataFrame([], "id string, name string"), policy, namespace or "default")


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/contexts", CONTEXT).drop("stream", "batch")


def block(text: str, heading: str = "# What is remembered") -> str:
    """a context under a heading, or nothing."""
    return f"{heading}\n{text}" if text else ""

