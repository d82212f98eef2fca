"""Texts to vectors by a model that each worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[list[float] | None]]


def encoded(rows: DataFrame, key: str, text: str, load: Callable[[], Model]) -> DataFrame:
    """(key, vector) of ``rows``: the model that ``load`` gives is asked for each distinct text once, in batches.

    ``load`` runs in the workers, once for each of a stream of batches. A batch for which the
    model fails has null vectors, as have null texts; so has all if ``load`` fails.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # no model is no vector: who compares then takes texts for alike
            model = None
        for texts in batches:
            try:
                found = model(list(texts)) if model else [None] * len(texts)
            except Exception:
                found = [None] * len(texts)
            yield pd.Series([None if v is None else [float(x) for x in v] for v in found], dtype=object)

    vectors = rows.filter(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().withColumn("vector", encode("_text"))
    return rows.select(key, F.col(text).alias("_text")).join(vectors, "_text", "left").select(key, "vector")
