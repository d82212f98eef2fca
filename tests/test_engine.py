"""The facade: inheritance, refusals, counters, the log, touches and cycles."""

import datetime

from mnemaspark.engine import Engine
from mnemaspark.sources import store
from mnemaspark.sources.log import ValidationLog
from tests.test_memory import MEMORY, memories

ASKED = "query_id long, question string, lang string"


def start(spark, log=None, policy="WARN"):
    return Engine(spark.createDataFrame([], MEMORY), spark.createDataFrame([], "id long, name string"), policy, log=log)


def test_writes_take_from_a_similar_memory(spark):
    m = memories(spark, (["Rita"], "pediu troca", "", "loja", 0.8), ([], "outro", "", "default", 0.5)).withColumn("lang", store.F.lit("pt"))
    base = start(spark).remember(m, validated=False)[0]
    new = memories(spark, ([], " pediu nota ", "", "default", 0.5), (["Caio"], "ligou", "", "", 0.5), (["Caio"], "veio", "", "sala", 0.9), ([], "sem ref", "", "default", 0.5))
    new = new.withColumn("similar_to", store.F.expr("CASE id WHEN 3 THEN 77 ELSE 0 END").cast("long")).withColumn("id", store.F.col("id") + 10)
    after, results = base.remember(new)
    got = {r["id"]: (r["who"], r["what"], r["place"], r["importance"], r["lang"]) for r in after.memories.filter("id >= 10").collect()}
    assert got == {10: (["Rita"], "pediu nota", "loja", 0.8 * 0.8, "pt"), 11: (["Caio"], "ligou", "loja", 0.8 * 0.8, "pt"), 12: (["Caio"], "veio", "sala", 0.9, "pt"), 13: ([], "sem ref", "default", 0.5, None)}
    texts = spark.createDataFrame([(20, 20, "um texto", 0.5, 0), (21, 21, "sem", None, None)], "id long, seq long, text string, importance double, similar_to long")
    made = {r["id"]: (r["who"], r["what"], r["place"], r["importance"], r["lang"]) for r in store.from_text(texts, m).collect()}
    assert made == {20: ([], "um texto", "loja", 0.8 * 0.8, "pt"), 21: ([], "sem", "default", 0.5, None)}


def test_counters_and_log(spark, tmp_path):
    log = ValidationLog(spark, str(tmp_path / "log"))
    assert log.history().count() == 0
    first, _ = start(spark, log, "BLOCK").remember(memories(spark, (["Rita"], "cliente pediu troca", "", "loja", 0.5), (["Rita"], "cliente não pediu troca", "", "loja", 0.5), (["Rita"], "troca pediu cliente", "", "loja", 0.5)), at="2024-01-01 00:00:00")
    refused = memories(spark, ([], " \n", "", "loja", 0.5), ([], "x", "", "loja", 1.5)).withColumn("id", store.F.col("id") + 10)
    second, results = first.remember(refused)
    assert {r["id"]: r["status"] for r in results.collect()} == {10: "REFUSED", 11: "REFUSED"} and second.memories.count() == 2
    third, results = second.remember(refused.filter("id = 11").withColumn("importance", store.F.lit(0.2)), validated=False)
    assert [(r["id"], r["status"]) for r in results.collect()] == [(11, None)] and third.memories.count() == 3
    third.recall(spark.createDataFrame([(1, "O que Rita pediu?", "pt"), (2, "?", "auto")], ASKED))[0].collect()
    third.inspect(spark.createDataFrame([(1, "O que Rita pediu?", "pt")], ASKED)).collect()
    assert vars(first.counters) == {"writes_total": 3, "writes_blocked": 1, "writes_warned": 1, "recalls_total": 2}
    assert {r["name"]: r["value"] for r in third.stats().collect()} == {
        "memories": "3", "entities": "0", "writes_total": "3", "writes_blocked": "1", "writes_warned": "1", "recalls_total": "2", "validator_policy": "BLOCK", "namespace": "default"}
    assert [r["id"] for r in log.blocked().collect()] == ["1"] and [(r["id"], r["similar_id"]) for r in log.warnings().collect()] == [("2", "0")]
    assert log.stats("BLOCK").first().asDict() == {"total": 3, "ok": 1, "warn": 1, "blocked": 1, "policy": "BLOCK", "embedding_check_enabled": False}
    # a batch that is written again counts once
    for _ in range(2):
        log.append(results, "b7", "2024-01-02 00:00:00")
    assert log.history().count() == 4
    log.clear()
    assert log.history().count() == 0 and log.stats("BLOCK").first()["total"] == 0
    log.append(results, "b8", "2024-01-03 00:00:00")
    assert log.history().count() == 1


def test_a_write_recalls_beside_what_it_was_stored(spark):
    base, _ = start(spark, policy="BLOCK").remember(memories(spark, (["Rita"], "cliente pediu troca", "", "loja", 0.5)))
    new = memories(spark, (["Rita"], "cliente não pediu troca", "", "loja", 0.5), (["Caio"], "pediu troca urgente", "", "loja", 0.5)).withColumn("id", store.F.col("id") + 5)
    after, results, packed = base.remember_and_recall(new)
    assert {r["id"]: r["status"] for r in results.collect()} == {5: "BLOCKED", 6: "OK"}
    assert {r["query_id"]: r["packed"] for r in packed.collect()} == {6: "Caio | pediu troca urgenteRita | cliente pediu troca"}


def test_recalls_touch_and_cycles_change(spark):
    base, _ = start(spark).remember(memories(spark, (["Rita"], "a b c d e f g", "", "loja", 0.5), (["Rita"], "a b c d e f g", "", "loja", 0.6), (["Caio"], "outra coisa", "", "sala", 0.2)))
    _, found = base.recall(spark.createDataFrame([(1, "quem é Caio?", "pt"), (2, "outra coisa", "pt")], ASKED))
    touched = base.touched(found, "2024-01-05 00:00:00")
    assert {r["id"]: r["access_count"] for r in touched.memories.collect()} == {0: 0, 1: 0, 2: 2}
    after, cycle = touched.dream("2024-01-24 00:00:00", n=1)
    got = {r["id"]: (r["consolidated_into"], r["importance"], r["access_count"], r["last_accessed"]) for r in after.memories.collect()}
    # two weeks at two accesses leave the third, three weeks without any don't leave the others
    assert got == {2: (None, 0.2, 3, datetime.datetime(2024, 1, 24))} and cycle.counts == {"n_cleaned": 2, "n_consolidated": 0, "n_replayed": 1}
    after, cycle = touched.dream("2024-01-10 00:00:00", n=1)
    got = {r["id"]: (r["consolidated_into"], round(r["importance"], 3), r["access_count"]) for r in after.memories.collect()}
    assert got == {0: (None, 0.55, 1), 1: (0, 0.6, 0), 2: (None, 0.2, 2)}
    # a memory merged away is not recalled, its count of structural matches is
    questions = spark.createDataFrame([(1, "quem é Rita?", "pt"), (2, "zzz", "pt")], ASKED)
    assert {r["id"] for r in after.recall(questions)[1].filter("query_id = 1").collect()} == {0}
    assert {r["query_id"]: (r["query_type"], r["structural_match_count"], r["semantic_fallback_count"]) for r in after.metrics(questions).collect()} == {1: ("identity", 2, None), 2: ("unknown", None, 0)}
