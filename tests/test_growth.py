"""What is shuffled must grow with rows, not with pairs of them."""

from mnemaspark.functions import similarity as S
from mnemaspark.operators import intent, recall, validate
from tests.test_memory import MEMORY


def shuffled(spark, make):
    """Rows that a job writes to shuffles, and its result."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        it, found = store.stageList(None, False, False, none, None).iterator(), {}
        while it.hasNext():
            s = it.next()
            found[s.stageId()] = s.shuffleWriteRecords()
        return found

    before = stages()
    rows = make().collect()
    return sum(n for k, n in stages().items() if k not in before), rows


def memory(i, who, what, place="p"):
    return (i, i, who, what, "", place, "", 0.5, None, None, 0, None, False, [], None, None)


def test_equal_questions_meet_contents_once(spark):
    memories = spark.createDataFrame([memory(i, ["ann" if i == 7 else "bob"], f"order open priority number{i}", f"town{i % 5}") for i in range(300)], MEMORY)
    questions = spark.createDataFrame([(i, "is the order open for ann" if i == 3 else "which order is open") for i in range(3000)], "query_id long, question string").selectExpr("*", "'en' AS lang")
    n, rows = shuffled(spark, lambda: recall.semantic(intent.with_intent(questions), memories))
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert len(got) == 3000 and sorted(got[0]) == sorted(got[2999]) == [(i + 1, i) for i in range(5)]
    assert sorted(got[3]) == [(1, 7), (2, 0), (3, 1), (4, 2), (5, 3)]
    assert n < 120_000  # each question with each content would be 900,000


def test_first_rows_are_found_without_sorting_all(spark):
    def peak(n):
        """Bytes of memory that the stages of n memories take, of the one that takes most, and what is found."""
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        rows = spark.range(n).selectExpr("'s' AS namespace", "id", "id AS seq", "array(concat('name', id)) AS who", "concat('what', id % 3) AS what", "repeat('y', 40) AS why", "'p' AS place", "0.5D AS importance")
        stages = lambda: {s.stageId(): s.peakExecutionMemory() for s in iterate(store.stageList(None, False, False, none, None))}
        before = stages()
        got = sorted((r["what"], r["seq"]) for r in recall.profiles(rows, 5).collect())
        return max(m for k, m in stages().items() if k not in before), got

    def iterate(found):
        it = found.iterator()
        while it.hasNext():
            yield it.next()

    (few, a), (many, b) = peak(4_000), peak(2_000_000)
    assert a == b == sorted((f"what{i % 3}", i) for i in range(15))
    assert many < 1.5 * few


def test_first_rows_with_ties_gaps_and_missing_values(spark):
    rows = [(i, None if i % 50 == 49 else (i * 37) % 400 // 2, "xyz"[i % 3] if i % 7 else None) for i in range(400)] + [(900, 5, "alone"), (901, None, "none")]
    table = spark.createDataFrame(rows, "id long, seq long, what string")
    for k in (1, 3, 80, 500):
        got, want = {}, {}
        for r in recall.earliest(table, ["what"], k).collect():
            got.setdefault(r["what"], []).append(-1 if r["seq"] is None else r["seq"])
        for _, seq, what in rows:
            want.setdefault(what, []).append(-1 if seq is None else seq)
        assert {w: sorted(v) for w, v in got.items()} == {w: sorted(v)[:k] for w, v in want.items()}


def test_texts_are_not_sorted_with_scores(spark):
    memories = spark.createDataFrame([memory(i, ["ann" if i % 9 == 7 else "bob"], f"order open number{i}", f"town{i % 5}") for i in range(40)], MEMORY)
    asked = intent.with_intent(spark.createDataFrame([(1, "what is ann", "en"), (2, "when was order open", "en")], "query_id long, question string, lang string"))
    for tier in (recall.structural, recall.semantic):
        found = tier(asked, memories)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Aggregate [query_id" in line and ("first(m#" in line or "first(what#" in line)]
        assert [(r["query_id"], r["rank"], r["id"], r["who"]) for r in found.collect() if r["query_id"] == 1 and r["rank"] < 3] == [(1, 1, 7, ["ann"]), (1, 2, 16, ["ann"])]
        assert sorted(r["id"] for r in found.collect() if r["query_id"] == 2) == [0, 1, 2, 3, 4]


def test_pairs_of_writes_stay_in_their_task(spark):
    says = ["order still open", "order not open still", "order still open now"]
    writes = spark.createDataFrame([memory(i, ["ann", "bob"] if i % 2 else ["bob", "cy", "ann"], says[i % 3]) for i in range(240)], MEMORY)
    n, rows = shuffled(spark, lambda: validate.judged(validate.overlapping(writes, writes)))
    # denials stand at 1, 4, 7, ...: the first write of the other kind contradicts; what is alike comes before that
    got = {r["id"]: (r["similar_id"], r["conflict_id"]) for r in rows}
    assert got == {i: (None if i == 2 else 0 if i % 3 == 0 else None, 0 if i % 3 == 1 else 1 if i > 1 else None) for i in got} and len(got) == 239
    assert n < 8_000  # 28,680 pairs


def test_words_in_common_are_counted_once_a_pair(spark):
    says = ["order still open", "order not open still", "", "order still open now"]
    writes = spark.createDataFrame([memory(i, [["ann"], ["bob", "ann"], []][i % 3], says[i % 4]) for i in range(24)], MEMORY)
    found = validate.judged(validate.overlapping(writes, writes))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # not in the join, where each test of a pair would count them again
    assert not [line for line in plan.splitlines() if "Join" in line and "array_intersect(ta" in line]
    own = {r["id"]: (set(r["who"]), set(r["what"].split())) for r in writes.collect()}
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {}
    for a in own:
        similar = conflict = None
        for b in range(a):
            if own[a][0] & own[b][0] or not own[a][0] or not own[b][0]:
                who, what, opposed = share(own[a][0], own[b][0]), share(own[a][1], own[b][1]), ("not" in own[a][1]) != ("not" in own[b][1])
                if conflict is None and what >= 0.85 and (similar is None or what > similar[1]):
                    similar = (b, what)
                if conflict is None and who >= 0.5 and what >= 0.3 and opposed:
                    conflict = b
        if similar or conflict is not None:
            want[a] = (similar and similar[0], conflict)
    assert {r["id"]: (r["similar_id"], r["conflict_id"]) for r in found.collect()} == want


def test_equal_vectors_are_compared_once(spark):
    writes = spark.createDataFrame([memory(i, ["ann"], "order still open") for i in range(60)], MEMORY)
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i < 40 else [0.0, 1.0]) for i in range(60)], "id long, vector array<double>")
    none = spark.createDataFrame([], "id long, name string")
    rows = validate.validate(writes, writes, none, "BLOCK", vectors).collect()
    assert {r["id"]: (r["level"], r["conflict_id"]) for r in rows} == {i: ("embedding", 0) if i >= 40 else ("redundancy", None) if i else ("none", None) for i in range(60)}
    pairs = validate.overlapping(*[writes.join(vectors.select("id", validate.digest().alias("vid")), "id")] * 2)
    assert pairs.select("va", "vb").distinct().count() == 3


def test_sets_that_share_rare_words_only_never_meet_whole(spark):
    """Sets of 400 words of which 40, the rarest, are shared by all: a candidate by its prefix, far from similar."""
    import random

    rng = random.Random(3)
    common = [f"c{i:03d}" for i in range(400)]
    sets = [(i, [f"rare{j}" for j in range(40)] + [f"own{i}-{j}" for j in range(i % 3)] + rng.sample(common, 360 - i % 3)) for i in range(60)]
    sets += [(100 + i, sets[i][1][:-20] + [f"new{i}-{j}" for j in range(20)]) for i in range(5)]
    rows = spark.createDataFrame(sets, "id long, toks array<string>")
    own = {i: set(t) for i, t in sets}
    wanted = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    for threshold, strict in ((0.7, True), (0.9, False)):
        want = {p: s for p, s in wanted.items() if (s > threshold if strict else s >= threshold)}
        got = {(r["a"], r["b"]): r["sim"] for r in S.similar_pairs(rows, [], "toks", threshold, strict, large=True).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_sketches_never_differ_in_more_bits_than_sets_in_tokens(spark):
    import random

    rng = random.Random(5)
    sets = {i: set(rng.sample(range(3000), rng.choice([1, 30, 900, 2500]))) for i in range(24)}
    single = spark.createDataFrame([(i, f"t{t}") for i, ts in sets.items() for t in ts], "id long, tok string")
    got = {r["id"]: r["sketch"] for r in S.sketches(single).collect()}
    differ = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(got[a], got[b], strict=True))
    for a in sets:
        for b in sets:
            far = len(sets[a] ^ sets[b])
            assert differ(a, b) <= far and (far - differ(a, b)) % 2 == 0
    few = [(a, b) for a in sets for b in sets if a < b and len(sets[a]) == len(sets[b]) == 900]
    assert all(differ(a, b) > 2 * 900 * 0.3 / 1.7 for a, b in few)  # told apart at 0.7


def test_a_group_of_vectors_is_two_blocks(spark, monkeypatch):
    from mnemaspark.operators import vector

    monkeypatch.setattr(vector, "BLOCK", 16)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(400)], "vec_id long, embedding array<float>")
    found = vector.top_k(vectors, vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 2)
    # no row of the plan holds a block: a worker is given rows, a group at a time
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    assert got[0, 1] == 1 and got[50, 1] == 51 and got[350, 1] == 351 and len(got) == 16


def test_a_document_is_parsed_once(spark):
    import re

    from mnemaspark.sources import export

    read = export.relations_read(spark.createDataFrame([('{"id": "1", "from_id": "a", "polarity": -1}',)], "document string"))
    heads = set(re.findall(r"from_json\(StructField\((\w+)", read._jdf.queryExecution().optimizedPlan().toString()))
    assert heads == {"id"}  # a schema cut for each field begins with that field
    r = read.first()
    assert (r["id"], r["from_id"], r["relation_type"], r["strength"], r["polarity"]) == ("1", "a", "", 0.5, -1.0)


def test_sets_of_frequent_words_are_found_by_twos_and_threes(spark, monkeypatch):
    """Near copies of all sizes whose words are all frequent: brute force finds the same, and few others meet."""
    import random

    from mnemaspark.functions import signatures

    monkeypatch.setattr(signatures, "ALONE", 1)
    monkeypatch.setattr(signatures, "BY_CHANCE", 0.5)
    monkeypatch.setattr(signatures, "GROUP_TOKENS", 3000)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(700)]
    sets = {i: set(rng.sample(words, n)) for i, n in enumerate([*range(1, 40), *(rng.randint(12, 500) for _ in range(160))])}
    for i in range(200, 420):
        base = sorted(sets[rng.randrange(i - 199 + 60)])
        sets[i] = set(rng.sample(base, max(1, round(len(base) * rng.uniform(0.7, 1))))) | set(rng.sample(words, round(len(base) * rng.uniform(0, 0.15))))
    share = lambda a, b: len(a & b) / len(a | b)
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, toks array<string>").repartition(3)
    for threshold in (0.7, 0.85):
        want = {(a, b): share(sets[a], sets[b]) for a in sets for b in sets if a < b and share(sets[a], sets[b]) >= threshold}
        got = {(r["a"], r["b"]): r["sim"] for r in S.similar_pairs(rows, [], "toks", threshold, large=True).collect()}
        assert got == want and len(want) > 50
    assert signatures.candidates(S.hashed(rows.limit(0), "toks"), 0.7, 0, 0).count() == 0
    with_others = rows.union(spark.createDataFrame([(1000, sorted(sets[5]))], rows.schema))
    assert (5, 1000, 1.0) in set(map(tuple, S.similar_pairs(with_others, [], "toks", 0.7, large=True).collect()))


def test_sets_of_frequent_words_seldom_meet(spark, monkeypatch):
    """Sets that are far from similar, of words that a tenth of all sets hold: single words would bring nearly each to each."""
    import random

    from mnemaspark.functions import signatures

    monkeypatch.setattr(signatures, "ALONE", 1)
    monkeypatch.setattr(signatures, "BY_CHANCE", 0.5)
    rng = random.Random(12)
    rows = spark.createDataFrame([(i, [f"w{j}" for j in rng.sample(range(600), 60)]) for i in range(600)], "id long, toks array<string>")
    before, after = S._candidates(rows, [], 0.7).count(), signatures.candidates(S.hashed(rows, "toks"), 0.7, 600, 36_000).count()
    assert before > 30_000 and after < before / 20
