"""Free text to memories, and cycles at intervals over a stored table."""

import datetime
import time

from pyspark.sql import types as T

from mnemaspark.operators import text_memory
from mnemaspark.sources.graph_table import GraphTable
from mnemaspark.streaming import maintenance
from tests.test_memory import MEMORY, memories

VECTORS = {"um pedido de troca": [1.0, 0.0], "Rita pediu troca": [0.9, 0.1], "Caio foi ao suporte hoje": [0.8, 0.3], "longe": [-1.0, 0.2], "outra coisa": [0.0, 1.0]}


def load():
    return lambda texts: [VECTORS.get(t) for t in texts]


def fields(df):
    return {r["id"]: (r["who"], r["what"], r["place"], r["when_text"], r["lang"], r["importance"]) for r in df.collect()}


def test_levels(spark):
    texts = spark.createDataFrame([(0, 0, "Rita pediu troca"), (1, 1, "Caio foi ao suporte hoje"), (2, 2, "longe"), (3, 3, None), (4, 4, " ")], "id long, seq long, text string")
    plain = fields(text_memory.extracted(texts))
    assert plain == {0: (["Rita"], "Rita pediu troca", "default", "", None, 0.5), 1: (["Caio"], "Caio foi ao suporte hoje", "suporte", "hoje", None, 0.5), 2: ([], "longe", "default", "", None, 0.5), 3: ([], "", "default", "", None, 0.5), 4: ([], " ", "default", "", None, 0.5)}
    m = memories(spark, ([], "um pedido de troca", "", "loja", 0.8), ([], "outra coisa", "", "sala", 0.1)).withColumn("lang", text_memory.F.lit("pt"))
    near = fields(text_memory.extracted(texts, m, load))
    # a place that the text names stays; a text that is near nothing, or has no vector, stays as it is
    assert near == plain | {0: (["Rita"], "Rita pediu troca", "loja", "", "pt", 0.8 * 0.8), 1: (["Caio"], "Caio foi ao suporte hoje", "suporte", "hoje", "pt", 0.8 * 0.8)}
    asked = fields(text_memory.extracted(texts, m, load, lambda prompts: ['Well: {"what": "algo", "who": ["Eva"], "where": ""} and {"what": "no"}'] * len(prompts)))
    assert asked == near | {i: (["Eva"], "algo", "default", "", None, 0.5) for i in (3, 4)}
    silent = fields(text_memory.extracted(texts, model=lambda prompts: ["no idea"] * len(prompts)))
    assert silent == plain


def test_cycles_at_intervals(spark, tmp_path):
    table = GraphTable(spark, str(tmp_path / "t"), T.StructType.fromDDL(MEMORY), 2)
    base = memories(spark, (["R"], "a b c", "", "p", 0.5), (["R"], "a b c", "", "p", 0.6), (["S"], "x", "", "p", 0.9))
    table.merge(base)
    before = {(r["id"], r["access_count"]) for r in table.read().collect()}
    query = maintenance.maintain(table, 1, 1, lambda: datetime.datetime(2024, 1, 2))
    seen, end = [], time.time() + 120
    try:
        while table.version() < 2 and time.time() < end:
            seen.append({(r["id"], r["access_count"]) for r in table.read().collect()})
    finally:
        query.stop()
    after = {r["id"]: (r["consolidated_into"], r["access_count"] > 0) for r in table.read().collect()}
    # readers saw the table as it was until the cycle's version was there
    assert all(s in (before, {(0, 1), (1, 0), (2, 1)}) for s in seen) and seen[0] == before
    assert after == {0: (None, True), 1: (0, False), 2: (None, True)}
