"""Records to documents and back, and the embedding check of writes."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from mnemaspark.functions import embedding
from mnemaspark.operators import intent, recall, validate
from mnemaspark.sources import export
from tests.test_memory import memories

NOW = "2024-05-01 10:00:00"


def documents(df, key="id"):
    return {r[key]: json.loads(r["document"]) for r in df.collect()}


def test_memories_there_and_back(spark):
    m = memories(spark, (["Ana", "Rui"], 'disse "olá"', "porque sim", "loja", 0.25), ([], "x", "", "default", 1.0))
    m = m.withColumns({"last_accessed": F.when(F.col("id") == 0, F.lit("2024-01-02 03:04:05.000678").cast("timestamp_ntz")), "metadata": F.create_map(F.lit("k"), F.lit("v")), "lang": F.lit("pt")})
    got = export.memory_documents(m)
    want = {"id": "0", "who": ["Ana", "Rui"], "what": 'disse "olá"', "why": "porque sim", "when": "2024-01-01T00:00:00", "where": "loja", "how": "", "importance": 0.25, "access_count": 0,
            "last_accessed": "2024-01-02T03:04:05.000678", "created_at": "2024-01-01T00:00:00", "metadata": {"k": "v"}}
    assert documents(got)[0] == want and list(documents(got)[0]) == list(want) and documents(got)[1]["last_accessed"] is None
    back = {r["id"]: r for r in export.memories_read(got, NOW).collect()}
    for r in m.collect():
        b = back[str(r["id"])]
        assert all(b[c] == r[c] for c in ("who", "what", "why", "place", "how", "importance", "access_count", "last_accessed", "created_at", "when_ts", "metadata")) and b["lang"] is None
    few = spark.createDataFrame([('{"what": "só isto", "lang": "pt", "other": 1}',), ("nonsense",), (None,)], "document string")
    r = {x["what"]: x for x in export.memories_read(few, NOW).collect()}
    one = r["só isto"]
    assert (one["who"], one["place"], one["importance"], one["access_count"], one["when_ts"], one["lang"]) == ([], "default", 0.5, 0, datetime.datetime(2024, 5, 1, 10), "pt") and len(one["id"]) == 36 and None in r


def test_entities_relations_intents(spark):
    e = spark.createDataFrame([("e1", "person", "Ana", ["a@x"], datetime.datetime(2024, 1, 1)), ("e2", "part", "ring", None, None)], "id string, type string, name string, identifiers array<string>, created_at timestamp_ntz")
    got = export.entity_documents(e)
    assert documents(got)["e1"] == {"id": "e1", "type": "person", "name": "Ana", "identifiers": ["a@x"], "attributes": {}, "created_at": "2024-01-01T00:00:00", "updated_at": None}
    assert {r["id"]: (r["type"], r["name"], r["identifiers"], r["attributes"]) for r in export.entities_read(got).collect()} == {"e1": ("person", "Ana", ["a@x"], {}), "e2": ("part", "ring", [], {})}
    rel = spark.createDataFrame([("r1", "a", "likes", "b", -1.0)], "id string, from_id string, relation_type string, to_id string, polarity double")
    got = export.relation_documents(rel)
    assert documents(got)["r1"] == {"id": "r1", "from_id": "a", "relation_type": "likes", "to_id": "b", "strength": 0.5, "polarity": -1.0, "attributes": {}, "created_at": None}
    assert export.relations_read(got).first().asDict() == {"id": "r1", "from_id": "a", "relation_type": "likes", "to_id": "b", "strength": 0.5, "polarity": -1.0, "attributes": {}}
    asked = intent.with_intent(spark.createDataFrame([(1, "O que João pediu?", "pt"), (2, "?", "pt")], "query_id long, question string, lang string"))
    got = export.intent_documents(asked)
    assert documents(got, "query_id")[1] == {"who": ["joão"], "what": "pediu", "why": "", "when": "", "where": "", "how": "", "query_type": "action", "confidence": 0.85, "raw_query": "O que João pediu?", "lang": "pt"}
    assert {r["query_id"]: (r["who"], r["confidence"]) for r in export.intents_read(got).collect()} == {1: (["joão"], 0.85), 2: ([], 0.0)}
    m = memories(spark, (["João"], "pediu nota", "", "loja", 0.5), (["Ana"], "veio", "", "loja", 0.5))
    got = documents(export.result_documents(asked, recall.tiered(asked, m), m, recall.metrics(asked, m)), "query_id")
    assert [x["what"] for x in got[1]["memories"]] == ["pediu nota"] and got[1]["metrics"]["structural_match_count"] == 1 and got[1]["metrics"]["intent"]["who"] == ["joão"]
    assert got[2]["memories"] == [] and "structural_match_count" not in got[2]["metrics"] and got[2]["entities"] == []


def test_validation_results(spark):
    m = memories(spark, (["Rita"], "cliente pediu troca", "", "loja", 0.5), (["Rita"], "cliente não pediu troca", "", "loja", 0.5), (["Caio", "Rui"], "veio cedo", "", "loja", 0.5), (["Rita"], "troca pediu cliente", "", "sala", 0.5), ([], " ", "", "sala", 0.5), (["Rita"], "troca cliente pediu", "", "sala", 0.5))
    things = spark.createDataFrame([(7, "rui"), (8, "RUI"), (5, "caio"), (9, "caio"), (1, "Rita")], "id long, name string")
    got = documents(export.validation_documents(validate.validate(m, m, things, "WARN", explain=True), NOW))
    assert {i: (d["status"], d["conflicting_memory_id"], d["similar_memory_id"], d["ambiguous_entity_ids"], d["detection_level"]) for i, d in got.items()} == {
        0: ("OK", None, None, [], "none"), 1: ("WARN", "0", None, [], "heuristic"), 2: ("WARN", None, None, ["5", "9", "7", "8"], "heuristic"), 3: ("OK", None, None, [], "none"), 4: ("WARN", None, None, [], "heuristic"), 5: ("WARN", None, "3", [], "token")}
    assert got[1]["metadata"] == {"who_overlap": "1.0", "what_overlap": "0.75", "downgraded_from": "BLOCKED"} and got[4]["metadata"] == {"missing_field": "what", "downgraded_from": "BLOCKED"} and got[5]["metadata"] == {"similarity_score": "1.0"}
    assert got[2]["timestamp"] == "2024-05-01T10:00:00" and got[2]["suggestions"]


VECTORS = {"esquece a loja nova": [-1.0, 0.1], "adora a loja nova": [1.0, 0.1], "visita a loja nova": [0.9, 0.2], "sem a loja nova": None}


def load(fails=False):
    if fails:
        raise RuntimeError("no model here")
    return lambda texts: [VECTORS.get(t) for t in texts]


def test_vectors_that_say_the_opposite(spark):
    m = memories(spark, (["Rita"], "adora a loja nova", "", "p", 0.5), (["Rita"], "odeia a loja nova", "", "p", 0.5), (["Caio"], "odeia a loja nova", "", "p", 0.5), (["Rita"], "visita a loja nova", "", "p", 0.5), (["Rita"], "sem a loja nova", "", "q", 0.5), (["Rita"], "outra a loja nova", "", "q", 0.5))
    none = spark.createDataFrame([], "id long, name string")
    # "odeia" and "sem" deny; leave the denial to the vectors
    m = m.withColumn("what", F.when(F.col("id") == 1, "esquece a loja nova").otherwise(F.col("what")))
    vectors = embedding.encoded(m, "id", "what", load)
    assert {r["id"]: r["vector"] for r in vectors.collect()}[4] is None
    plain = {r["id"]: (r["status"], r["level"]) for r in validate.validate(m, m, none, "BLOCK").collect()}
    got = {r["id"]: (r["status"], r["level"], r["conflict_id"]) for r in validate.validate(m, m, none, "BLOCK", vectors).collect()}
    assert plain[1][0] == "OK" and got[1] == ("BLOCKED", "embedding", 0)
    # the first conflict counts, one without a vector is alike, other participants aren't compared
    assert got[3] == ("BLOCKED", "embedding", 1) and got[2][1] == "none" and got[5] == ("BLOCKED", "contradiction", 4)
    # a model that can't be loaded leaves the other checks
    broken = embedding.encoded(m, "id", "what", lambda: load(True))
    assert {r["id"]: (r["status"], r["level"]) for r in validate.validate(m, m, none, "BLOCK", broken).collect()} == plain


@pytest.mark.parametrize("sim", [0.39, 0.41])
def test_the_limit_of_likeness(spark, sim):
    a, b = [1.0, 0.0], [sim, (1 - sim**2) ** 0.5]
    m = memories(spark, (["R"], "um dois tres", "", "p", 0.5), (["R"], "um dois quatro", "", "p", 0.5))
    vectors = spark.createDataFrame([(0, a), (1, b)], "id long, vector array<double>")
    got = {r["id"]: r["level"] for r in validate.validate(m, m, spark.createDataFrame([], "id long, name string"), "BLOCK", vectors).collect()}
    assert got[1] == ("embedding" if sim < 0.4 else "none")
