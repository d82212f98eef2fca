"""Chats through the stream against a run turn by turn."""

from mnemaspark.streaming import bridge, memory_stream

AT = "2024-01-01 00:00:00"
CHAT = [
    # batches of (conv_id, turn, role, text)
    [(1, 0, "user", "Maria pediu troca na loja"), (1, 1, "assistant", "feito"), (2, 0, "system", "seja breve"), (2, 1, "user", "Maria mora em casa")],
    [(1, 2, "user", "Maria não pediu troca na loja"), (1, 3, "assistant", "ok"), (1, 4, "user", "O que Maria pediu?"), (2, 2, "user", "quem é Maria?"), (2, 3, "assistant", None)],
    [(1, 5, "assistant", "nada")],
]
#: What a run turn by turn gives, each conversation by itself, where contradictions are blocked: the context of each user turn, and the exchanges stored with their answers.
CONTEXTS = {(1, 0): "", (1, 2): "Maria | Maria pediu troca na loja", (1, 4): "Maria | Maria pediu troca na loja", (2, 1): "", (2, 2): "Maria | Maria mora em casa"}
STORED = [("1/0", "feito"), ("1/4", "nada"), ("2/1", ""), ("2/2", "")]


def test_a_replayed_chat(spark, tmp_path):
    for batch in CHAT:
        spark.createDataFrame(batch, bridge.TURN).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        stream = spark.readStream.schema(bridge.TURN).parquet(str(tmp_path / "turns"))
        bridge.converse(stream, str(tmp_path / "chat"), str(tmp_path / "checkpoint"), AT, "BLOCK").awaitTermination()
    assert {(r["conv_id"], r["turn"]): r["context"] for r in bridge.contexts(spark, str(tmp_path / "chat")).collect()} == CONTEXTS
    every = bridge.engine(spark, str(tmp_path / "chat"))
    assert sorted((r["id"], r["how"]) for r in every.memories.collect()) == STORED
    own = bridge.engine(spark, str(tmp_path / "chat"), namespace="chat-1")
    assert {r["id"] for r in own.about("maria").collect()} == {"1/0", "1/4"}
    assert {r["name"]: r["value"] for r in own.stats().collect()}["namespace"] == "chat-1"
    assert bridge.block("x").endswith("\nx") and bridge.block("") == ""


def test_turn_numbers_don_t_clash(spark):
    turns = spark.createDataFrame([(1, 100_000, "user", "a"), (2, 0, "user", "b"), (0, 200_000, "user", "c"), (None, 0, "user", "d"), (None, 1, "user", "e")], bridge.TURN)
    ids = [r["id"] for r in memory_stream.turn_memories(turns).collect()]
    assert len(set(ids)) == 5 and 200_000 in ids and sum(i < 0 for i in ids) == 4
