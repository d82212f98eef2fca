"""Accesses as keyed state: each recall moves a memory's counters and the time at which it is forgotten.

The stream keeps a row of state for each memory, with the moment at which retrievability falls below
the limit. A write starts it, a touch (a recall that returned the memory, or a replay) adds to the
count, sets the last access and moves that moment. When the watermark passes it, the memory is
deleted. So after each batch the memories left are those of ``dream.cleanup`` at the watermark over
all touches so far, without a pass over the table of memories.

A batch is summed up by id, joined with the state that the batch before it left, and written as the
next state, all in native columns. The state is read and written whole, so a trigger should
bring much at once.

Batches and streams share one form of update, (id, kind, at, and for writes what decides how
long a memory lasts): recalls, replays and writes of a batch job can be appended to the folder that a
stream reads.
"""

from __future__ import annotations

import datetime
import hashlib
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decay as D
from ..sources.store import _at

UPDATE = "id long, kind string, at timestamp, importance double, access_count int, last_accessed timestamp, when_ts timestamp, consolidated boolean"
#: A row without id holds the watermark as ``at``. Rows that are ``gone`` or not ``touched`` by the batch are told apart for the table of changes.
STATE = "id long, written boolean, access_count long, last timestamp, since timestamp, importance double, consolidated boolean, gone boolean, touched boolean, at timestamp"
CHANGE = "id long, access_count long, last_accessed timestamp, deleted boolean, at timestamp"
DAY = 86_400_000_000


# ---- updates ------------------------------------------------------------------------------


def _update(rows: DataFrame, kind: str, **values) -> DataFrame:
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(UPDATE).fields
    return rows.select(*[(F.lit(kind) if f.name == "kind" else values.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in fields])


def writes(memories: DataFrame) -> DataFrame:
    """Memories as updates, at the time they were made."""
    own = {c: F.col(c) for c in ("id", "importance", "access_count", "last_accessed", "when_ts")}
    return _update(memories, "write", at=F.coalesce("created_at", "when_ts"), consolidated=D.consolidated(), **own)


def touches(found: DataFrame, at: str) -> DataFrame:
    """What a recall (a row for each question and memory returned) or a replay does to the memories: a touch each."""
    return _update(found, "touch", id=F.col("id"), at=F.lit(at).cast("timestamp_ntz"))


def touched(memories: DataFrame, updates: DataFrame) -> DataFrame:
    """F29 over a table: ``memories`` with the count and the last time of their touches added."""
    hits = updates.filter("kind = 'touch'").groupBy("id").agg(F.count("*").alias("_hits"), F.max("at").cast("timestamp_ntz").alias("_at"))
    m = memories.join(hits, "id", "left")
    count = (F.col("access_count") + F.coalesce("_hits", F.lit(0))).cast(memories.schema["access_count"].dataType)
    return m.withColumns({"access_count": count, "last_accessed": F.greatest("last_accessed", "_at")}).select(*memories.columns)


# ---- the keyed state ----------------------------------------------------------------------


def advance(state: DataFrame, updates: DataFrame, now: datetime.datetime, least: float = D.FORGOTTEN, config: D.Decay = D.Decay()) -> DataFrame:
    """The STATE rows that ``updates`` make of ``state``, with what has faded by ``now`` marked as gone.

    A touch that comes before its write waits for it, as long as a memory of no importance that
    was touched so often would last; a second write of an id replaces the first. What is deleted
    stays deleted unless it is written again.
    """
    kind, w = F.col("kind"), F.col("w")
    seen = updates.groupBy("id").agg(
        F.max(F.when(kind == "write", F.struct("at", "when_ts", "importance", "access_count", "last_accessed", "consolidated"))).alias("w"),
        F.count_if(kind == "touch").alias("hits"), F.max(F.when(kind == "touch", F.col("at"))).alias("hit_at"), F.max("at").alias("seen_at"))
    old = state.filter("id is not null and not gone").drop("gone", "touched", "at")
    new, known = w.isNotNull(), F.coalesce("written", F.lit(False))
    either = lambda its, name: F.when(new, its).otherwise(F.col(name))
    count = F.coalesce("access_count", F.lit(0))
    # touches that came before their write belong to it; a second write starts anew
    count = F.when(new, F.coalesce(w["access_count"], F.lit(0)) + F.when(known, 0).otherwise(count)).otherwise(count) + F.coalesce("hits", F.lit(0))
    last = F.greatest(either(F.greatest(w["last_accessed"], F.when(~known, F.col("last"))), "last"), F.col("hit_at"))
    rows = old.join(seen, "id", "full_outer").select(
        "id", (known | new).alias("written"), count.cast("long").alias("access_count"), last.alias("last"), either(F.coalesce(w["when_ts"], w["at"]), "since").alias("since"),
        F.coalesce(either(w["importance"], "importance"), F.lit(0.0)).alias("importance"), F.coalesce(either(w["consolidated"], "consolidated"), F.lit(False)).alias("consolidated"),
        (new | (F.coalesce("hits", F.lit(0)) > 0)).alias("touched"), F.col("seen_at").alias("at"))
    # from the last access to the moment at which retrievability falls below the limit, to the next millisecond
    lasts = D.stability(config, F.col("consolidated")) * (math.log(1 / least) * DAY)
    until = F.floor((F.unix_micros(F.coalesce("last", "since")) + lasts) / 1000) + 1
    gone = until <= F.unix_millis(F.lit(now))
    return rows.withColumn("gone", gone).withColumn("at", F.when(F.col("gone"), F.timestamp_millis(until)).otherwise(F.col("at"))).select(*[x.split()[0] for x in STATE.split(", ")])


def keep_access(updates: DataFrame, table: str, checkpoint: str, least: float = D.FORGOTTEN, late: str = "0 seconds"):
    """A started query that keeps ``table`` up to date with a stream of updates; all that is there is taken in, in batches.

    ``table`` has a part for each batch, replaced if the batch runs again; see ``current``. The
    state lies beside the checkpoint, as the last two batches left it. The watermark is the latest
    time seen less ``late``; rows up to that of the batch before and rows with null id are left out.
    """
    spark, name = updates.sparkSession, hashlib.md5(checkpoint.encode()).hexdigest()
    folder = lambda batch_id: f"{checkpoint.rstrip('/')}/memories/batch={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        fs, before = _at(own, folder(batch_id - 1))
        state = own.read.schema(STATE).parquet(folder(batch_id - 1)) if fs.exists(before) else own.createDataFrame([], STATE)
        mark = state.filter("id is null").select("at")
        was = (mark.first() or [None])[0]
        known = batch.filter("id is not null" if was is None else F.col("id").isNotNull() & (F.col("at") > F.lit(was)))
        latest = known.agg(F.timestamp_millis(F.unix_millis(F.max("at")) - F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {late}"))).alias("at"))
        now = latest.unionByName(mark).agg(F.max("at")).first()[0]
        if now is None:
            return
        row = own.range(1).select(*[(F.lit(now) if f.name == "at" else F.lit(None)).cast(f.dataType).alias(f.name) for f in state.schema.fields])
        advance(state, known, now, least).unionByName(row).write.mode("overwrite").parquet(folder(batch_id))
        after = own.read.schema(STATE).parquet(folder(batch_id)).filter("id is not null and written and (gone or touched)")
        after.select("id", "access_count", F.col("last").alias("last_accessed"), F.col("gone").alias("deleted"), "at").write.mode("overwrite").parquet(f"{table}/stream={name}/batch={batch_id}")
        fs, done = _at(own, folder(batch_id - 2))
        fs.delete(done, True)

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last change of each memory, from a table that one stream keeps."""
    rows = spark.read.schema(CHANGE + ", stream string, batch long").parquet(table)
    last = rows.groupBy("id").agg(F.max_by(F.struct("access_count", "last_accessed", "deleted", "at"), "batch").alias("r"))
    return last.select("id", "r.*")


def applied(memories: DataFrame, now: DataFrame) -> DataFrame:
    """``memories`` as the stream has left them: deleted ones gone, counts and last accesses taken over."""
    state = now.select("id", F.col("access_count").alias("_n"), F.col("last_accessed").alias("_at"), F.col("deleted").alias("_gone"))
    m = memories.join(state, "id", "left").filter("_gone is null or not _gone")
    count = F.coalesce(F.col("_n").cast(memories.schema["access_count"].dataType), "access_count")
    return m.withColumns({"access_count": count, "last_accessed": F.when(F.col("_n").isNotNull(), F.col("_at").cast("timestamp_ntz")).otherwise(F.col("last_accessed"))}).select(*memories.columns)
