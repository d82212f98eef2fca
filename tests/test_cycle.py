"""Dream cycles that change the memories, by a plain run one by one; and their merge into a stored table."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import types as T

from mnemaspark.functions import decay as D
from mnemaspark.operators import dream
from mnemaspark.sources.graph_table import ConcurrentMerge, GraphTable
from tests.test_memory import MEMORY

START, AS_OF = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 3, 1)
NAMES = [x.strip().split()[0] for x in MEMORY.split(", ")]


def made(i, who, what, place="p", importance=0.5, days=50, **more):
    at = START + datetime.timedelta(days=days)
    row = dict(zip(NAMES, (i, i, who, what, "", place, "", importance, at, at, 0, None, False, [], None, None), strict=True))
    return row | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], MEMORY)


def table(df):
    return {r["id"]: r.asDict() for r in df.collect()}


def one_by_one(rows, model=None, budget=5):
    """The cycle over a list in order of seq; summaries have ids of their own."""
    rows = [dict(r) for r in rows]

    def r(m):
        s = D.stability_of(m["access_count"], m["importance"], m["is_summary"] or bool(m["consolidated_from"]))
        return math.exp(-max(0.0, (AS_OF - (m["last_accessed"] or m["when_ts"])).total_seconds() / 86400) / s)

    kept = [m for m in rows if r(m) >= 0.05]
    cleaned, merged = len(rows) - len(kept), 0
    buckets = {}
    for m in kept:
        if m["consolidated_into"] is None:
            buckets.setdefault((m["place"] or "default", frozenset(m["who"])), []).append(m)
    for group in buckets.values():
        taken = set()
        for i, a in enumerate(group):
            words = set(a["what"].lower().split())
            if a["id"] in taken or not words:
                continue
            cluster = [a]
            for b in group[i + 1:]:
                other = set(b["what"].lower().split())
                if b["id"] not in taken and other and len(words & other) / len(words | other) >= (0.45 if model else 0.85):
                    cluster.append(b)
                    taken.add(b["id"])
            if len(cluster) < 2:
                continue
            merged += len(cluster) - 1
            said = None
            if model and budget > 0:
                try:
                    said = json.loads(model(cluster))
                except Exception:
                    said = None
            if said and said.get("what", "").strip():
                budget -= 1
                who = []
                for m in cluster:
                    who += [w for w in m["who"] if w not in who]
                new = made(("summary", a["id"]), who, said["what"].strip(), cluster[0]["place"], min(1.0, max(m["importance"] for m in cluster) + 0.05), why=said.get("why", ""), is_summary=True, consolidated_from=[m["id"] for m in cluster])
                kept.append(new)
                for m in cluster:
                    m["consolidated_into"] = new["id"]
                continue
            best = max(cluster, key=lambda m: len(m["what"]))
            for m in cluster:
                if m is not best:
                    m["consolidated_into"] = best["id"]
            best["importance"] = min(1.0, best["importance"] + 0.05)
    live = sorted((m for m in kept if m["consolidated_into"] is None), key=lambda m: -m["importance"])
    for m in live[:5]:
        m["access_count"] += 1
        m["last_accessed"] = AS_OF
    return kept, {"n_cleaned": cleaned, "n_consolidated": merged, "n_replayed": min(5, len(live))}


def brief(m, name=lambda x: x):
    return (name(m["id"]), m["what"], m["importance"], m["access_count"], m["last_accessed"], m["consolidated_into"] and name(m["consolidated_into"]), m["is_summary"], tuple(map(str, m["consolidated_from"])), tuple(m["who"]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    out = [made(i, rng.choice([["A"], ["B", "A"], ["A", "B"], []]), " ".join(rng.sample(words, rng.randint(0, 6))) + rng.choice(["", " W1", " longer"]), rng.choice(["p", "q", ""]), rng.choice([0.1, 0.5, 0.97]), rng.choice([0, 40, 55])) for i in range(1, 61)]
    return [*out, made(90, ["A"], "w0 w1", consolidated_into=1), made(91, ["A"], "w0 w1", is_summary=True, consolidated_from=[1, 2], days=20)]


def test_a_cycle_gives_the_table_of_one_run_by_hand(spark, rows, tmp_path):
    memories = frame(spark, rows)
    got = dream.run_cycle(memories, str(AS_OF))
    want, counts = one_by_one(rows)
    assert got.counts == counts and counts["n_cleaned"] and counts["n_consolidated"]
    assert {i: brief(m) for i, m in table(got.memories).items()} == {m["id"]: brief(m) for m in want}
    # merged into a stored table, saved, read again: the same rows, in their old order
    store = GraphTable(spark, str(tmp_path / "graph"), T.StructType.fromDDL(MEMORY), 4)
    assert store.read().count() == 0
    store.merge(memories)
    store.merge(got.changed, got.deleted)
    back = table(store.read())
    assert back == table(got.memories) and [back[m["id"]]["seq"] for m in want] == [m["seq"] for m in want]


def test_a_model_merges_as_far_as_its_budget_goes(spark, rows):
    answers = []

    def by_hand(cluster):
        text = "|".join(m["what"] for m in cluster)
        if "longer" in text:
            raise RuntimeError("no answer")
        return json.dumps({"what": f" all of {len(cluster)} ", "why": "merged", "how": ""})

    def model(prompts):
        answers.append(len(prompts))
        if any("longer" in p for p in prompts):
            raise RuntimeError("no answer")
        return [f'Sure: {{"what": " all of {p.count(chr(10)) - 3} ", "why": "merged", "how": ""}} done' for p in prompts]

    got = dream.run_cycle(frame(spark, rows), str(AS_OF), model=model, budget=3)
    want, counts = one_by_one(rows, by_hand, 3)
    assert got.counts == counts
    new = {("summary", min(map(int, m["consolidated_from"]))): m for m in table(got.memories).values() if m["is_summary"] and m["id"] != 91}
    name = {m["id"]: k for k, m in new.items()}
    assert len(new) == 3 == len([m for m in want if isinstance(m["id"], tuple)])
    assert sorted((brief(m, lambda i: name.get(i, i)) for m in table(got.memories).values()), key=repr) == sorted((brief(m) for m in want), key=repr)
    assert {m["why"] for m in new.values()} == {"merged"}


def test_a_model_that_never_answers_leaves_the_plain_merge(spark, rows):
    def silent(prompts):
        return ["", "{}", "not json", '{"what": "  "}'][: len(prompts)] + [""] * (len(prompts) - 4)

    got = dream.run_cycle(frame(spark, rows), str(AS_OF), model=silent)
    want, counts = one_by_one(rows, lambda _: "nothing")
    assert got.counts == counts and {i: brief(m) for i, m in table(got.memories).items()} == {m["id"]: brief(m) for m in want}


def test_merges_rewrite_what_they_touch(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, seq long, x int")
    store = GraphTable(spark, str(tmp_path / "t"), schema, 8)
    rows = lambda *r: spark.createDataFrame(r, schema)
    assert store.merge(rows(*[(f"k{i}", i, 0) for i in range(40)])) == 1
    first = store.listed(1)
    assert store.merge(rows(("k3", 99, 7), ("new", 100, 1)), rows(("k5", 0, 0), ("none", 0, 0))) == 2
    got = {r["id"]: (r["seq"], r["x"]) for r in store.read().collect()}
    assert got == {f"k{i}": (i, 7 if i == 3 else 0) for i in range(40) if i != 5} | {"new": (100, 1)}
    second = store.listed(2)
    assert 0 < sum(first[b] == second.get(b) for b in first) < len(first)
    # readers of the old version go on; then it is cleared away
    assert store.read(1).count() == 40 and {r["x"] for r in store.read(1).collect()} == {0}
    late = GraphTable(spark, str(tmp_path / "t"), schema, 8)
    late.version = lambda: 1  # as one that began before the second merge
    with pytest.raises(ConcurrentMerge):
        late.merge(rows(("k1", 1, 5)))
    assert store.vacuum() >= 1 and store.read().count() == 40
    with pytest.raises(ValueError):
        store.merge(rows((None, 1, 1)))
    store.merge(None, store.read())
    assert store.read().count() == 0
