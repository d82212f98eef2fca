"""Turns and accesses as streams: validated writes by micro-batch, access state by event time."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import extract_where, extract_who
from ..operators import validate

SPAN = 100_000


def turn_memories(turns: DataFrame) -> DataFrame:
    """User turns as memories, without answers (see ``bridge`` for exchanges); works on a stream as on a table. An extracted time is not used.

    Turns beyond those that a conversation's span of numbers holds are numbered by hash, below zero.
    """
    inside = F.col("conv_id").between(0, 1 << 45) & F.col("turn").between(0, SPAN - 1)
    number = F.when(inside, F.col("conv_id") * SPAN + F.col("turn")).otherwise(F.xxhash64("conv_id", "turn").bitwiseOR(F.lit(-1 << 63)))
    return turns.filter("role = 'user'").select(
        number.alias("id"), number.alias("seq"), extract_who(F.col("text")).alias("who"),
        F.col("text").alias("what"), F.lit("").alias("why"), extract_where(F.col("text")).alias("place"), F.lit("").alias("how"), F.lit(0.6).alias("importance"),
        F.lit(None).cast("timestamp_ntz").alias("when_ts"))


def stored(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """All rows that ``store_turns`` wrote to ``table``, with the stream and batch that brought them; none if it isn't there."""
    full = StructType([*schema.fields, StructField("stream", StringType()), StructField("batch", LongType())])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(full).parquet(table) if there else spark.createDataFrame([], full)


def store_turns(stream: DataFrame, table: str, checkpoint: str, policy: str = "WARN"):
    """A started query that validates each micro-batch against ``table`` and the batch itself, and adds what is not blocked.

    ``table`` is a folder that only this function writes, a part for each batch of a stream
    (known by its checkpoint). A batch that runs again replaces its own part. Batches come in
    order of arrival, rows within one by conversation and turn.
    """
    spark, name = stream.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()
    things = spark.createDataFrame([], "id long, name string")
    schema = turn_memories(stream).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.persist()
        try:
            old = stored(spark, table, schema).filter((F.col("stream") != name) | (F.col("batch") < batch_id)).drop("stream", "batch")
            _, taken = validate.validate_in_order(new, old, things, policy)
            taken.write.mode("overwrite").parquet(f"{table}/stream={name}/batch={batch_id}")
        finally:
            new.unpersist()

    return turn_memories(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def access_counts(events: DataFrame) -> DataFrame:
    """Running access count and last access of each key of an event stream."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


def access_windows(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Accesses a key and window; rows later than ``late`` are left out. (An addition: windows have no counterpart in a single store.)"""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("accesses"))
