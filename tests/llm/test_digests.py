"""The digest queries of encoders and shards against the libraries, on texts of all kinds."""

import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest

from mnemaspark.llm import bpe, queries, sharding, tokenout

SCHEMA = "doc_id long, text string, size int, crc string, copy string, shard string, slot long, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = ["Straße", "naïve", "hello", "日本語", "🙂", "ﬁ", "12345", "don't", "\t", "  ", "\n\n", "x" * 300, "é" * 90, "<|endoftext|>", "АБВ", "á"]
    texts = [None, "", " ", " ", "one", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(40)], "z" * 20_000, "字" * 3000]
    rows = [(i, t, 1, "c", "c", "c", 2, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", 1, "c", "c", "c", 2, "n"), (4, "one", 1, "c", "c", "c", 2, "n"), (4, "another", 1, "c", "c", "c", 2, "n")], SCHEMA).repartition(3)


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_byte_bpe(spark, docs):
    import tiktoken

    path = public_tokenizers.path(queries.BYTE_BPE)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for doc, text in texts(docs):
        ids = library.encode_ordinary(text)
        want.append((doc, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.bpe_digest(docs, path, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.bpe_digest(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    library, start, want = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(texts(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    got = [tuple(r) for r in tokenout.token_digest(docs, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_shards(spark, docs, tmp_path):
    got = [(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts(docs)), key=repr)
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns)
    keep = ["doc_id", "text", "size", "crc", "copy", "n_tokens"]
    assert sorted(map(repr, back.select(*keep).collect())) == sorted(map(repr, docs.select(*keep).collect()))
    slots = {}
    for r in back.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
