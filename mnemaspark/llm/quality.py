"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Words, runs of punctuation and their pairs are hashed into 2**BITS coordinates. Training
reads a sample of the labelled rows of a stated size (``MAX_LABELLED``), so one task holds
it whatever the size of the corpus. The model is a vector of 2**BITS weights and a bias, of
fixed size; scoring streams every whole text through a sparse dot product, with no shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, append, without, worker_model

BITS = 18
MAX_LABELLED = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
MEMO = 200_000
REPEAT = np.uint64(0x5851F42D4C957F2D)
MIN_UPDATES = 48_000

_TOKEN = re.compile(r"\w+|[^\w\s]{1,3}")


class Hasher:
    """Coordinates and values of a text: words and word pairs, square roots of their shares (of unit length)."""

    def __init__(self):
        self.memo = Memo(lambda words: [zlib.crc32(w.encode()) for w in words], MEMO)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall((text or "").lower())
        one = np.array(self.memo.of(tokens), dtype=np.uint64)
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        two[one[:-1] == one[1:]] = REPEAT  # a word said twice is one feature, whatever the word
        mixed = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two * np.uint64(0xFF51AFD7ED558CCD)])
        at, count = np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
        return at, np.sqrt(count / max(count.sum(), 1))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal updates over ``rows`` in the order given; weights and bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(max(EPOCHS, min(20, MIN_UPDATES // max(len(rows), 1)))):
        for at, value, label in rows:
            at, value = np.append(at, size), np.append(value, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], float(w[size])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias from about ``bound`` labelled rows outside the held-out fold.

    Rows are drawn by a hash of doc_id. A doc_id labelled both ways is left out, as are null
    labels; without any label left all weights are 0.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).filter("lo = hi")
        .select(F.col("doc_id").alias("op3_id"), F.col("lo").cast("int").alias("op3_label"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("op3_draw"))
    )
    total = known.count()
    drawn = known.filter(F.col("op3_draw") < int((1 << 30) * min(1.0, bound / max(total, 1))))
    # about ``bound`` rows of three numbers, so they go to every executor
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("op3_id")).select("op3_draw", "op3_id", "op3_label", "text")

    def features(batches):
        import pyarrow as pa

        hasher = worker_model("words", Hasher)
        for b in batches:
            draw, ids, label, text = (b.column(i).to_pylist() for i in range(4))
            at, value = zip(*map(hasher, text), strict=True) if text else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(draw, pa.int64()), pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([v.astype(np.float32).tobytes() for v in value], pa.binary())], names=["draw", "id", "label", "at", "value"])

    def learn(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], r[3], r[4]))
        w, bias = train([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float), label) for _, _, label, a, v in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias), pa.float64())], names=["at", "w"])

    hashed = sample.mapInArrow(features, "draw long, id long, label int, at binary, value binary")
    found = hashed.repartition(1).mapInArrow(learn, "at long, w double").toPandas()
    weights = np.zeros(1 << BITS)
    bias = 0.0
    for at, w in zip(found["at"], found["w"], strict=True):
        if at < 0:
            bias = w
        else:
            weights[at] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``. Null and empty texts get the bias alone."""
    weights, bias = model
    weights = weights.astype(np.float32)

    def run(batch):
        import pyarrow as pa

        hasher = worker_model("words", Hasher)
        out = []
        for text in batch.column(batch.schema.get_field_index("text")):
            at, value = hasher(text.as_py())
            out.append(float(weights[at] @ value) + bias)
        return [pa.array(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -35, 35))), pa.float64())]

    return append(docs, "score double", run, ("predicted",)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``docs``."""
    rows = docs.select("doc_id", "text")
    return score(rows, fit(rows, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less the rows predicted to be of low quality, with the columns of ``docs``."""
    scored = score(docs.select("*"), fit(docs, labels))
    return without(scored.filter("predicted = 1"), "score", "predicted").select(*[f"`{c}`" for c in docs.columns if c not in ("score", "predicted")])
