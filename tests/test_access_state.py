"""Accesses as a stream against the same as a batch, trigger by trigger."""

import datetime
import random

from pyspark.sql import functions as F

from mnemaspark.functions import decay as D
from mnemaspark.operators import dream
from mnemaspark.streaming import access_state
from tests.test_memory import MEMORY

START = datetime.datetime(2024, 1, 1)


def memory(i, at, importance=0.5, summary=False):
    return (i, i, ["R"], f"fact {i}", "", "p", "", importance, at, at, 0, None, summary, [], None, None)


def rows(df):
    return {r["id"]: (r["access_count"], r["last_accessed"]) for r in df.collect()}


def test_a_stream_of_recalls_ends_as_the_batches_do(spark, tmp_path):
    rng = random.Random(11)
    alive = spark.createDataFrame([], MEMORY)
    now = START
    gone_in_all = 0
    for step in range(4):
        now += datetime.timedelta(days=[3, 25, 40, 18][step])
        new = spark.createDataFrame([memory(step * 10 + i, now - datetime.timedelta(hours=i), rng.choice([0.2, 0.9]), rng.random() < 0.3) for i in range(4)], MEMORY)
        alive = spark.createDataFrame(alive.union(new).collect(), MEMORY)
        ids = [r["id"] for r in alive.collect()]
        # the trigger's last touch is that of memory 9999, which no one wrote: its time is the watermark
        found = spark.createDataFrame([(i,) for i in rng.choices(ids, k=6)], "id long")
        updates = access_state.writes(new).union(access_state.touches(found, str(now - datetime.timedelta(hours=1)))).union(access_state.touches(spark.createDataFrame([(9999,)], "id long"), str(now)))
        updates.coalesce(1).write.mode("append").parquet(str(tmp_path / "updates"))
        # each trigger is a query of its own that starts from the checkpoint
        stream = spark.readStream.schema(access_state.UPDATE).parquet(str(tmp_path / "updates"))
        access_state.keep_access(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
        left = dream.cleanup(access_state.touched(alive, updates), str(now))
        state = access_state.current(spark, str(tmp_path / "table"))
        assert rows(access_state.applied(alive, state)) == rows(left)
        assert {r["id"] for r in state.filter("deleted").collect()} & set(ids) == set(ids) - set(rows(left))
        gone_in_all += len(set(ids) - set(rows(left)))
        alive = left
    assert 0 < gone_in_all and alive.count()


def test_replays_and_recalls_write_the_same_update(spark):
    m = spark.createDataFrame([memory(i, START, i / 10) for i in range(4)], MEMORY)
    again = access_state.touched(m, access_state.touches(dream.replay(m, 2), "2024-03-01 00:00:00"))
    assert rows(again) == {0: (0, None), 1: (0, None), 2: (1, datetime.datetime(2024, 3, 1)), 3: (1, datetime.datetime(2024, 3, 1))}
    twice = access_state.touched(again, access_state.touches(m.filter("id = 3").union(m.filter("id = 3")), "2024-02-01 00:00:00"))
    assert rows(twice)[3] == (3, datetime.datetime(2024, 3, 1)) and rows(twice)[0] == (0, None)


def test_touches_that_come_before_their_write(spark, tmp_path):
    touch = access_state.touches(spark.createDataFrame([(1,), (1,), (None,)], "id long"), "2024-01-02 00:00:00")
    for updates in (touch, access_state.writes(spark.createDataFrame([memory(1, START)], MEMORY))):
        updates.coalesce(1).write.mode("append").parquet(str(tmp_path / "updates"))
        stream = spark.readStream.schema(access_state.UPDATE).parquet(str(tmp_path / "updates"))
        access_state.keep_access(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), late="7 days").awaitTermination()
    state = access_state.current(spark, str(tmp_path / "table"))
    assert rows(state) == {1: (2, datetime.datetime(2024, 1, 2))}


def test_stability_of_one_memory_is_that_of_the_column(spark):
    m = spark.createDataFrame([memory(i, START, rng, bool(i % 2)) for i, rng in enumerate((0.1, 0.7, 0.71, 1.0))], MEMORY).withColumn("access_count", F.col("id").cast("int") * 5)
    for r in m.select("access_count", "importance", D.consolidated().alias("c"), D.stability().alias("s")).collect():
        assert abs(D.stability_of(r["access_count"], r["importance"], r["c"]) - r["s"]) < 1e-12


def test_advancing_the_state_is_native_and_is_the_fold_of_each_memory(spark):
    """20,000 memories in two batches: no row of Python, and each memory as its own events leave it."""
    at = lambda days: f"timestamp '2024-01-01 00:00:00' + make_dt_interval(CAST({days} AS int))"
    ids = spark.range(20_000)
    none = "CAST(NULL AS timestamp)"
    write = ids.filter("id % 4 <> 3").selectExpr("id", "'write' AS kind", f"{at('0')} AS at", "0.5D AS importance", "2 AS access_count", f"{none} AS last_accessed", f"{none} AS when_ts", "id % 2 = 0 AS consolidated")
    touch = ids.filter("id % 3 = 0").selectExpr("id", "'touch' AS kind", f"{at('30')} AS at", "NULL AS importance", "NULL AS access_count", f"{none} AS last_accessed", f"{none} AS when_ts", "NULL AS consolidated")
    empty = spark.createDataFrame([], access_state.STATE)
    # the touches come first and wait for their write, which fades where there were none
    one = access_state.advance(empty, touch, START + datetime.timedelta(days=30), 0.3)
    two = access_state.advance(one, write, START + datetime.timedelta(days=31), 0.3)
    assert "Python" not in two._jdf.queryExecution().toString() and "Pandas" not in two._jdf.queryExecution().toString()
    got = {r["id"]: r for r in two.collect()}
    assert len(got) == sum(i % 4 != 3 or i % 3 == 0 for i in range(20_000))
    for i, r in got.items():
        n = (2 if i % 4 != 3 else 0) + (i % 3 == 0)
        idle = 1 if i % 3 == 0 else 31
        lasts = D.stability_of(n, 0.5 if i % 4 != 3 else 0.0, i % 4 != 3 and i % 2 == 0) * 1.2039728043259361
        assert (r["written"], r["access_count"], r["gone"]) == (i % 4 != 3, n, idle > lasts), i
