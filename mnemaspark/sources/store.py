"""The JSON file of a memory graph, read and written; upserts; the constructor's normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

CURRENT = "current.txt"
MEMORY = (
    "id string, who array<string>, what string, why string, `when` string, `where` string, how string, importance double, access_count int, "
    "last_accessed string, created_at string, metadata map<string,string>, lang string"
)
ENTITY = "id string, type string, name string, identifiers array<string>, attributes map<string,string>, created_at string, updated_at string"
RELATION = "id string, from_id string, relation_type string, to_id string, strength double, polarity double, attributes map<string,string>, created_at string"


def load(spark: SparkSession, path: str, namespace: str = "default") -> dict[str, DataFrame]:
    """memories, entities and relations of a graph file, or of a folder that ``save`` wrote.

    A missing file is an empty graph; the file's own namespace wins. A folder without a saved version is an error.
    """
    from pyspark.sql import types as T

    parts = {"memories": T.StructType.fromDDL(MEMORY), "entities": T.StructType.fromDDL(ENTITY), "relations": T.StructType.fromDDL(RELATION)}
    schema = T.StructType([T.StructField("namespace", T.StringType()), *[T.StructField(k, T.ArrayType(v)) for k, v in parts.items()]])
    fs, at = _at(spark, path)
    there = fs.exists(at)
    if there and fs.getFileStatus(at).isDirectory():
        version = spark.read.text(f"{path}/{CURRENT}").first()[0]
        return {k: spark.read.schema(T.StructType([T.StructField("namespace", T.StringType()), T.StructField("seq", T.LongType()), *v.fields])).json(f"{path}/{version}/{k}") for k, v in parts.items()}
    file = spark.read.schema(schema).json(path, multiLine=True) if there else spark.createDataFrame([], schema)
    out = {}
    for k in parts:
        rows = file.select(F.coalesce("namespace", F.lit(namespace)).alias("namespace"), F.posexplode(k).alias("seq", "r"))
        out[k] = rows.select("namespace", F.col("seq").cast("long").alias("seq"), "r.*")
    return out


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(tables: dict[str, DataFrame], path: str, namespace: str = "default") -> None:
    """The three tables as JSON lines in a new folder under ``path``; then the file that names the current one is replaced.

    The replacement is one rename, atomic on file systems that have it; readers see the old
    version or the new one. Older versions stay, as someone may still read them.
    """
    missing = {"memories", "entities", "relations"} - set(tables)
    if missing:
        raise ValueError(f"no table for {sorted(missing)}")
    spark, version = tables["memories"].sparkSession, f"v-{uuid.uuid4().hex}"
    for k, df in tables.items():
        own = F.coalesce("namespace", F.lit(namespace)) if "namespace" in df.columns else F.lit(namespace)
        df.withColumn("namespace", own).write.json(f"{path}/{version}/{k}")
    point(spark, path, version)


def point(spark: SparkSession, path: str, version: str) -> None:
    """Makes ``version`` the current one of ``path``: the file that names it is replaced by one rename."""
    jvm, gateway, conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
    fs, new = _at(spark, f"{path}/_{version}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    context.rename(fs.makeQualified(new), fs.makeQualified(_at(spark, f"{path}/{CURRENT}")[1]), how)


def exported(memories: DataFrame) -> DataFrame:
    """The columns that the file has; language and consolidation are not among them."""
    return memories.select("id", "who", "what", "why", "when_ts", "place", "how", "importance", "access_count", "last_accessed", "created_at")


def record(memories: DataFrame) -> DataFrame:
    """The audit record: importance rounded half-even to three places."""
    return memories.select("id", "who", "what", "why", "place", "how", F.bround("importance", 3).alias("importance"), "access_count")


def upsert(rows: DataFrame, key: list[str], write: str) -> DataFrame:
    """The last write of each key; ``seq`` is the place of its first."""
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.col(write)).alias("r"), F.min(write).alias("seq"))
    return last.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], "seq")


def normalised(rows: DataFrame) -> DataFrame:
    """What the constructor makes of a memory's columns, those that are there; ``valid`` is false where it would refuse.

    Contents are stripped, participants too and blank ones dropped, an empty place is the
    default, a time given as text is read as ISO and is ``now`` where it can't be.
    """
    who = F.filter(F.transform(F.coalesce("who", F.array().cast("array<string>")), stripped), lambda w: w != "")
    place: Column = F.when(F.coalesce("place", F.lit("")) == "", "default").otherwise(F.col("place"))
    what = stripped(F.col("what"))
    valid = (what != "") & F.coalesce(F.col("importance").between(0.0, 1.0), F.lit(False))
    more = {c: F.coalesce(c, F.lit("")) for c in ("why", "how") if c in rows.columns}
    if "when_ts" in rows.columns:
        when = F.col("when_ts")
        more["when_ts"] = F.coalesce(F.try_to_timestamp(when).cast("timestamp_ntz") if rows.schema["when_ts"].dataType.typeName() == "string" else when, F.localtimestamp())
    return rows.withColumns({"who": who, "what": what, "place": place, **more, "valid": valid})


def inherited(writes: DataFrame, memories: DataFrame) -> DataFrame:
    """what a write leaves open comes from the memory whose id is its ``similar_to``, if it has one.

    The place where it is the default, the language where there is none, participants where there
    are none, and 0.8 of the importance where that is the default of 0.5. A reference to a memory that isn't
    there gives nothing.
    """
    if "similar_to" not in writes.columns:
        return writes
    ref = memories.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("who", "place", "importance", "lang")])
    known = F.col("_id").isNotNull()
    open_who = F.size(F.coalesce("who", F.array().cast("array<string>"))) == 0
    rows = writes.join(ref, F.col("similar_to") == F.col("_id"), "left").withColumns({
        "who": F.when(known & open_who, F.col("_who")).otherwise(F.col("who")), "place": F.when(known & (F.coalesce(F.nullif("place", F.lit("")), F.lit("default")) == "default"), F.col("_place")).otherwise(F.col("place")),
        "importance": F.when(known & (F.col("importance") == 0.5), F.col("_importance") * 0.8).otherwise(F.col("importance")),
        **({"lang": F.coalesce("lang", "_lang")} if "lang" in writes.columns else {})})
    return rows.select(*[c for c in writes.columns if c != "similar_to"])


def from_text(texts: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories of plain texts (id, seq, text, importance, similar_to): place, way, language and 0.8 of the importance of the reference, never its participants.

    Without a reference the place is the default and the importance is the text's own.
    """
    ref = memories.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("place", "how", "importance", "lang")])
    known = F.col("_id").isNotNull()
    return texts.join(ref, F.col("similar_to") == F.col("_id"), "left").select(
        "id", "seq", F.array().cast("array<string>").alias("who"), F.col("text").alias("what"), F.lit("").alias("why"), F.coalesce("_place", F.lit("default")).alias("place"), F.coalesce("_how", F.lit("")).alias("how"),
        F.when(known, F.col("_importance") * 0.8).otherwise(F.coalesce("importance", F.lit(0.5))).alias("importance"), F.col("_lang").alias("lang"))


def pair_turns(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows, or an empty one."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumn("next_role", F.lead("role").over(order)).withColumn("next_text", F.lead("text").over(order))
    return nxt.filter("role = 'user'").select("conv_id", "turn", "text", F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("answer"))
