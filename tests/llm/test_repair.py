"""Repair of conversations against all edits tried one by one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from mnemaspark.llm import repair
from mnemaspark.llm.common import Stage

SCHEMA = "conv_id long, turn long, role string, text string, block long, audit string, n int"
LEGAL = re.compile("(s?(ua)+)?")
PREFIX = re.compile("(s?(ua)*u?)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, costs):
    """(cost, audit, repaired rows) by trying everything."""
    kinds, best = faults(rows), None
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    long = {"u": "user", "a": "assistant"}

    def walk(i, cost, audit, made, shape):
        nonlocal best
        if not PREFIX.fullmatch(shape) or (best and cost > best[0]):
            return
        for extra in inserts if costs.insert < 4 or i in (0, len(rows)) else [()]:
            c, a, m, s = cost + costs.insert * len(extra), audit + "I" * len(extra), made + [(long[x], "") for x in extra], shape + "".join(extra)
            if i == len(rows):
                if LEGAL.fullmatch(s) and (best is None or (c, a) < best[:2]):
                    best = (c, a, m)
                continue
            role, text = rows[i]
            walk(i + 1, c + costs.delete, a + "D", m, s)
            if kinds[i] in ("", "truncated"):
                stay = costs.truncated if kinds[i] else 0
                if role:  # a row without a role has no initial to keep
                    walk(i + 1, c + stay, a + "K", [*m, (role, text)], s + role[:1])
                for x in "ua":
                    walk(i + 1, c + stay + costs.rerole, a + "R", [*m, (long[x], text)], s + x)

    walk(0, 0, "", [], "")
    return best


def report(conv, rows, turns, costs):
    kinds = faults(rows)
    real = [t for t in turns if t is not None]
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(rows)]
    cost, audit, made = cheapest(rows, costs)
    gaps = max(real) - min(real) + 1 - len(set(real)) if real else 0
    return (conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit), made


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


@pytest.mark.parametrize(("block", "costs"), [(512, repair.Costs()), (2, repair.Costs()), (2, repair.Costs(rerole=2, delete=3, insert=1, truncated=1))])
def test_repairs_are_the_cheapest(spark, monkeypatch, block, costs):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block + costs.insert)
    texts, roles = ["a.", "b!", "", " \n", "c", "d ?", None], ["user", "assistant", "system", "tool", "", None, "univ"]
    rows = []
    for conv in [None, *range(30)]:
        for _ in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([None, *range(5)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts), 0, "clash", 1))
    rows += [(99, 3, "user", "x.", 0, "c", 1)] * 5 + [(99, 4, "assistant", "y.", 0, "c", 1)] * 2
    found, made = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), Stage(spark, "t"), costs)
    repaired = {}
    for r in sorted(made.collect(), key=lambda r: (r["pos"], r["sub"])):
        repaired.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r) for r in found.collect()}
    convs = {r[0] for r in rows}
    assert got.keys() == convs
    for conv in convs:
        own = ordered([r for r in rows if r[0] == conv])
        want, rows_left = report(conv, [(r[2] or "", r[3] or "") for r in own], [r[1] for r in own], costs)
        assert got[conv] == want
        assert repaired.get(conv, []) == rows_left


def test_the_digest_after_damage(spark):
    rng = random.Random(4)
    rows = [(c, t, ["user", "assistant"][t % 2], f"text {rng.randint(0, 3)}." if rng.random() < 0.9 else None, 0, "x", 1) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(None, None, None, None, 0, "x", 1), (500, None, "user", "hi.", 0, "x", 1)]
    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    want = []
    for conv in {r[0] for r in rows}:
        own = []
        for _, t, role, text, *_ in ordered([r for r in rows if r[0] == conv]):
            role, text, k = " " if role is None else role, " " if text is None else text, kind(conv, t)
            row = (t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            own += [row] * (0 if k == 0 else 2 if k == 3 else 1)
        fixed, made = report(conv, [r[1:] for r in own], [r[0] for r in own], repair.Costs()) if own else ((conv, 0, 0, 0, 0, 0, 0, ""), [])
        want.append((*fixed, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    got = [tuple(r) for r in repair.repair_digest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert repair.repair_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_conversation_is_folded_by_blocks(spark):
    n = 3 * repair.BLOCK + 8
    rows = [(1, t, ["user", "assistant"][t % 2], "é" * (20_000 if t == 5 else 0) + f"{t}.", 0, "x", 1) for t in range(n) if t != 100]
    found, made = repair.repair(spark.createDataFrame(rows, SCHEMA), Stage(spark, "t"))
    got = found.first()
    # a user's turn is missing, so one assistant too many is deleted
    assert (got["gaps"], got["illegal"], got["cost"]) == (1, 1, 2) and len(got["audit"]) == n - 1 and made.count() == n - 2
