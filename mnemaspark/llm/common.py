"""What the operators of this subpackage share: tables, staged intermediates, null-safe columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mnemaspark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(_remove_local, found[len("file://"):])
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Spark's setting for removing the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Intermediates written as Parquet in the shared folder.

    A written table cuts the lineage: executors lost later cost only the tasks that
    were reading it. ``drop`` removes a table whose successor is already written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """``df`` written (a folder for each value of ``parts``) and read again. Shuffle files of the write go when it ends."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*parts).parquet(self.path(name))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name)) if parts else self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add under these names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def append(df: DataFrame, fields: str, fn, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns made by ``fn(batch) -> list of arrow arrays``, streamed by Arrow batches.

    Columns of ``df`` with the names of new ones are replaced; all others pass unchanged.
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(fields)
    names = [f.name for f in new.fields]
    kept = without(df, *names, *drop).columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *fn(b)], names=[*kept, *names])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *new.fields]))


class Memo:
    """What a worker remembers of words, about ``limit`` of them.

    Two generations: the younger fills up to half of the limit, then takes the place of the
    older; a word still in use moves from the older to the younger. ``make`` is given a list
    of words not met before and returns their values. After ``learn(words)``, ``get`` has all of them.
    """

    def __init__(self, make, limit: int):
        self.make, self.half, self.younger, self.older = make, limit // 2, {}, {}
        self.get = self.younger.__getitem__

    def learn(self, words: set) -> None:
        new = words.difference(self.younger)
        if not new:
            return
        if len(self.younger) + len(new) > self.half:
            self.older, self.younger, new = self.younger, {}, words
            self.get = self.younger.__getitem__
        again = self.older.keys() & new
        self.younger.update(zip(again, map(self.older.__getitem__, again), strict=True))
        todo = list(new - again)
        if todo:
            self.younger.update(zip(todo, self.make(todo), strict=True))

    def of(self, words: list) -> list:
        self.learn(set(words))
        return list(map(self.get, words))


_MODEL: dict = {}


def worker_model(key, make):
    """The model named ``key`` of this worker process, made where it isn't there yet.

    It outlives a task. A process keeps one model only: that of the operator it works for.
    """
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make()
    return _MODEL[key]
