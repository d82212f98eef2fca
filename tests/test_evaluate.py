"""The evaluation harness against the published figures of two scenarios."""

import json

import pytest

from mnemaspark.operators import evaluate

# The two published scenarios, whose figures are known (who, what, why, where, importance).
SUPPORT = [
    (["Maria"], "reportou erro de pagamento", "cartão expirado", "suporte", 0.7), (["Maria"], "ligou pedindo segunda via", None, "suporte", 0.5),
    (["João"], "elogiou tempo de resposta", None, "suporte", 0.4), (["João"], "pediu reembolso do pedido 12345", "produto com defeito", "suporte", 0.7),
    (["Ana"], "cancelou assinatura", "achou caro", "suporte", 0.5), (["Pedro"], "pediu suporte técnico para servidor", None, "infra", 0.6),
    (["Pedro"], "reportou bug crítico em produção", "memory leak", "infra", 0.9), (["Carla"], "solicitou upgrade de plano", None, "vendas", 0.4),
]
ASSISTANT = [
    (["User"], "prefere café sem açúcar", None, "preferences", 0.5), (["User"], "trabalha melhor de manhã", None, "preferences", 0.6), (["User"], "tem reunião toda terça às 10h", None, "calendar", 0.7),
    (["User"], "gosta de livros de ficção científica", None, "interests", 0.4), (["Maria"], "é esposa do User", None, "family", 0.8), (["João"], "é filho do User", None, "family", 0.7),
    (["User"], "comprou presente para Maria", "aniversário", "shopping", 0.5),
]
#: question, who is relevant, tokens, precision at 5.
ASKED = {
    "customer_support": [
        ("O que Maria pediu?", "Maria", 37, 0.5), ("Quem ligou pedindo segunda via?", "Maria", 8, 1.0), ("O que João pediu?", "João", 28, 0.667), ("Por que Ana cancelou?", "Ana", 10, 1.0),
        ("O que você sabe sobre Pedro?", "Pedro", 20, 1.0), ("Quem pediu reembolso?", "João", 20, 0.5),
    ],
    "personal_assistant": [
        ("Como o User prefere o café?", "User", 7, 1.0), ("Quando User tem reunião?", "User", 9, 1.0), ("Quem é Maria?", "Maria", 14, 0.5), ("O que User comprou para Maria?", "User", 38, 0.8),
        ("O que você sabe sobre User?", "User", 43, 1.0),
    ],
}
CANDIDATES = {
    "customer_support": [("Maria", "não reportou erro", "suporte", True), ("Pedro", "não reportou bug", "infra", True), ("Maria", "comprou produto", "suporte", False), ("João", "elogiou atendimento", "suporte", False)],
    "personal_assistant": [("User", "prefere café com açúcar", "preferences", True), ("User", "trabalha melhor de noite", "preferences", True), ("User", "tem reunião toda quarta", "calendar", False), ("User", "odeia ficção científica", "interests", True)],
}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("scenarios")
    for name, facts in (("customer_support", SUPPORT), ("personal_assistant", ASSISTANT)):
        (at / f"{name}.json").write_text(json.dumps({
            "scenario": name, "description": "x", "language": "pt-BR",
            "memories": [{"who": who, "what": what, "where": place, "importance": i} | ({"why": why} if why else {}) for who, what, why, place, i in facts],
            "queries": [{"query": q, "relevant_who": [who]} for q, who, *_ in ASKED[name]],
            "candidate_writes_contradicting": [{"who": [who], "what": what, "where": place, "should_block": block, "reason": "r"} for who, what, place, block in CANDIDATES[name]],
        }, ensure_ascii=False, indent=2))
    return evaluate.scenarios(spark, str(at))


def test_published_figures(spark, loaded, tmp_path):
    memories, questions, candidates = loaded
    assert (memories.count(), questions.count(), candidates.count()) == (15, 11, 8)
    each = evaluate.by_question(memories, questions).cache()
    got = {r["question"]: (r["namespace"], r["tokens"], round(r["precision"], 3)) for r in each.collect()}
    assert got == {q: (name, tokens, p) for name, asked in ASKED.items() for q, _, tokens, p in asked}
    assert {(r["namespace"], r["base_tokens"]) for r in each.collect()} == {("customer_support", 90), ("personal_assistant", 76)}
    rows = evaluate.by_scenario(each, evaluate.detections(memories, candidates)).cache()
    assert {r["namespace"]: (r["base_tokens"], r["tokens"], r["savings_pct"], r["base_precision"], r["precision"], r["tp"], r["fn"], r["fp"], r["tn"], r["detection_pct"]) for r in rows.collect()} == {
        "customer_support": (540, 123, 77.2, 0.367, 0.778, 2, 0, 0, 2, 100.0), "personal_assistant": (380, 111, 70.8, 0.84, 0.86, 2, 1, 0, 1, 66.7)}
    assert evaluate.overall(rows).first().asDict() == {"n_scenarios": 2, "savings_pct": 74.0, "base_precision": 0.603, "precision": 0.819, "detection_pct": 83.3}
    evaluate.write_results(each, rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/scenarios")).count() == 2 and spark.read.json(str(tmp_path / "out/overall")).first()["precision"] == 0.819


def test_scenarios_are_apart(spark, tmp_path):
    """Equal names and contents of another scenario don't count; what lacks fields has their defaults."""
    base = {"memories": [{"who": ["Ana"], "what": "paga conta"}, {"what": "  "}, {"who": ["Ana"], "what": "x", "importance": 7}], "queries": [{"query": "quem é Ana?"}]}
    (tmp_path / "a.json").write_text(json.dumps({"scenario": "a", **base, "candidate_writes_contradicting": [{"who": ["Ana"], "what": "não paga conta", "should_block": True}]}))
    (tmp_path / "b.json").write_text(json.dumps({"scenario": "b", "memories": [{"who": ["Rui"], "what": "dorme"}], "queries": [{"query": "quem é Ana?", "relevant_who": ["ANA"]}], "candidate_writes_contradicting": [{"who": ["Ana"], "what": "não paga conta", "should_block": True}]}))
    memories, questions, candidates = evaluate.scenarios(spark, str(tmp_path))
    assert {(r["namespace"], r["what"], r["place"], r["importance"]) for r in memories.collect()} == {("a", "paga conta", "default", 0.5), ("b", "dorme", "default", 0.5)}
    each = {r["namespace"]: (r["tokens"], r["precision"]) for r in evaluate.by_question(memories, questions).collect()}
    assert each == {"a": (len("Ana | paga conta") // 4, 0.0), "b": (0, 0.0)}
    assert {r["namespace"]: (r["tp"], r["fn"]) for r in evaluate.detections(memories, candidates).collect()} == {"a": (1, 0), "b": (0, 1)}
