"""Repair of the structure of conversations: the cheapest edits that make their roles legal.

Rows are put in order by one range shuffle and numbered; blocks of at most ``BLOCK`` rows
of one conversation, without texts, are what is looked at together. Windows inside blocks
(and one over the first occurrences of blocks) give each row its faults. The turns of a block, sorted,
are then folded by ``aggregate`` with four structs (cost, audit), one for each state of

    nothing -> s -> u <-> a        (s? (ua)+, or nothing)

by ``least`` over the edits that lead there. A conversation of one block is folded from the state
"nothing"; of a longer one each block is folded from all four, and a fold over its blocks
composes them, so that no task sees more of a conversation than its audits. Equal costs are
settled by the audit, which is the next field of the struct.

Texts travel beside this, as rows: they meet their edits by (conversation, block).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

BLOCK = 512
SPACE = r"\x20\x09-\x0D"
STATES = ("nothing", "system", "user", "assistant")
#: Edits as letters of the audit; ``roles`` beside it has the role of each: k its own, u and a after an edit, U and A inserted, - deleted.
PATH = "struct<cost:bigint,audit:string,roles:string>"


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# ---- damage, for trials -------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the trial's damage, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space there, and in role and text.

    0 drops a row, 1 empties its text, 2 takes the text's full stops, exclamation and question
    marks, 3 repeats it, 4 makes it a user's. Turn and conv_id stay null where they were.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).drop("one")


# ---- rows in order ------------------------------------------------------------------------


def ordered(rows: DataFrame, stage: Stage) -> DataFrame:
    """Rows equal in all as one with ``n`` copies, numbered by ``pos`` in order of conversation, turn (nulls first), role and text. Staged.

    Positions of a conversation may have gaps, but a block (``pos`` over BLOCK) never has rows of
    two tasks, as a task's positions start at a multiple of 2 ** 33.
    """
    # a row that stands for copies: its first copy is judged, the others are duplicates of it
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    # the range key holds the beginnings only: it is sampled to the driver, and what is equal in it stays in one task
    parted = own.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64))
    sorted_ = parted.sortWithinPartitions("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64), "role", "text")
    last = F.regexp_extract("text", rf"([^{SPACE}])[{SPACE}]*\z", 1)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return stage.write(sorted_.select(
        F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), same.alias("same"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
    ).withColumn("block", F.floor(F.col("pos") / BLOCK)), "turns")


def flagged(turns: DataFrame) -> DataFrame:
    """Turns without texts, with what windows say: must (delete), cut (truncated), illegal, and for the block its place ``at``."""
    rows = turns.select("conv_id", "block", "pos", "turn", "n", "initial", "same", "blank", "open")
    block = Window.partitionBy("conv_id", "block").orderBy("pos")
    before = F.lag("initial").over(block)
    rows = rows.withColumns({
        "nth": F.row_number().over(Window.partitionBy("conv_id", "block", "same").orderBy("pos")), "at": F.coalesce(F.sum("n").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        # a row's copies stand side by side, and no two equal initials are legal
        "illegal": F.when(before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au"), 1).otherwise(0) + F.col("n") - 1,
        "fresh": (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(block))).cast("long")})
    # only a block's first row of a text asks the blocks before it
    first = rows.filter("nth = 1").withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "same").orderBy("pos")) > 1)
    rows = first.unionByName(rows.filter("nth > 1").withColumn("again", F.lit(True)))
    return rows.withColumns({"must": F.col("blank") | F.col("again"), "cut": ~F.col("blank") & ~F.col("again") & F.col("open")})


# ---- the fold -----------------------------------------------------------------------------


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once."""
    return F.transform(F.array(x), f)[0]


def _then(path: Column, cost: Column | int, audit: Column | str, roles: Column | str) -> Column:
    """A path and one edit more; no path stays none."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    grown = F.struct((path["cost"] + lit(cost)).cast("bigint").alias("cost"), F.concat(path["audit"], lit(audit)).alias("audit"), F.concat(path["roles"], lit(roles)).alias("roles"))
    return F.when(path.isNotNull(), grown)


def _none() -> Column:
    return F.lit(None).cast(PATH)


def _states(paths: list[Column]) -> Column:
    return F.struct(*[p.alias(s) for p, s in zip(paths, STATES, strict=True)])


def _start(state: Column) -> Column:
    empty = F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("roles"))
    return _states([F.when(state == i, empty).otherwise(_none()) for i in range(4)])


def _inserted(s: Column, costs: Costs) -> Column:
    """The states with turns inserted: a user, then an assistant; more would only come back to a state."""
    user = lambda s: F.least(s["user"], _let(F.least(s["nothing"], s["system"], s["assistant"]), lambda p: _then(p, costs.insert, "I", "U")))
    return _let(user(s), lambda u: _states([s["nothing"], s["system"], u, F.least(s["assistant"], _then(u, costs.insert, "I", "A"))]))


def _turn(s: Column, t: Column, costs: Costs) -> Column:
    """The states after the turn ``t`` (initial, must, cut, n), by the cheapest of deleting, keeping and rerolling it."""
    rest = F.repeat(F.lit("D"), (t["n"] - 1).cast("int"))  # copies of the turn
    gone = F.repeat(F.lit("-"), (t["n"] - 1).cast("int"))
    more = (t["n"] - 1) * costs.delete
    stay = F.when(t["cut"], costs.truncated).otherwise(0) + more
    delete = lambda p: _then(p, t["n"] * costs.delete, F.concat(F.lit("D"), rest), F.concat(F.lit("-"), gone))
    keep = lambda p, initial: F.when(~t["must"] & (t["initial"] == initial), _then(p, stay, F.concat(F.lit("K"), rest), F.concat(F.lit("k"), gone)))
    rerole = lambda p, role: F.when(~t["must"], _then(p, stay + costs.rerole, F.concat(F.lit("R"), rest), F.concat(F.lit(role), gone)))
    to_user = lambda s: F.least(s["nothing"], s["system"], s["assistant"])
    return _let(_inserted(s, costs), lambda s: _let(to_user(s), lambda p: _states([
        delete(s["nothing"]), F.least(delete(s["system"]), keep(s["nothing"], "s")),
        F.least(delete(s["user"]), keep(p, "u"), rerole(p, "u")), F.least(delete(s["assistant"]), keep(s["user"], "a"), rerole(s["user"], "a"))])))


def folded(flags: DataFrame, stage: Stage, costs: Costs) -> DataFrame:
    """A row for each block: its counts and borders, and ``folds``: for each start state, the four states after the block. Staged."""
    turn = F.struct("pos", "initial", "must", "cut", "n")
    blocks = stage.write(flags.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.sum(F.when(F.col("blank"), F.col("n"))).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1))).alias("duplicate"), F.count_if("cut").alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("fresh").alias("fresh"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), F.min_by("turn", "pos").alias("first_turn"), F.max_by("turn", "pos").alias("last_turn"),
        F.min_by("initial", "pos").alias("first"), F.max_by("initial", "pos").alias("last")), "blocks")
    long = blocks.groupBy(F.col("conv_id").alias("c")).count().filter("count > 1").withColumn("long", F.lit(True)).drop("count")
    known = blocks.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    starts = F.when(F.col("long"), F.array(*map(F.lit, range(4)))).otherwise(F.array(F.lit(0)))
    folds = F.transform(starts, lambda i: F.aggregate("turns", _start(i), lambda s, t: _turn(s, t, costs)))
    return stage.write(known.withColumn("folds", folds).drop("turns", "long"), "folds")


def composed(blocks: DataFrame, costs: Costs) -> DataFrame:
    """A row for each conversation: its counts, cost, audit, and ``ways``: (block, roles) in order, and ``end``: roles inserted after the last row."""
    PATHS = "struct<cost:bigint,audit:string,path:array<int>>"
    order = F.array_sort(F.collect_list(F.struct("block", "folds", "first", "last", "first_turn", "last_turn")))
    whole = blocks.groupBy("conv_id").agg(
        order.alias("blocks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")], F.min("least").alias("least"), F.max("most").alias("most"))
    start = F.struct(*[F.when(F.lit(i == 0), F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit"), F.array(F.lit(0)).alias("path"))).otherwise(F.lit(None).cast(PATHS)).alias(s) for i, s in enumerate(STATES)])

    def step(s: Column, b: Column) -> Column:
        def reach(to: int) -> Column:
            ways = []
            for i, name in enumerate(STATES):
                own, more = s[name], F.get(b["folds"], F.lit(i))[STATES[to]]
                grown = F.struct((own["cost"] + more["cost"]).alias("cost"), F.concat(own["audit"], more["audit"]).alias("audit"), F.concat(own["path"], F.array(F.lit(to))).alias("path"))
                ways.append(F.when(own.isNotNull() & more.isNotNull(), grown))
            return F.least(*ways)

        return F.struct(*[reach(i).alias(name) for i, name in enumerate(STATES)])

    def ended(s: Column) -> Column:
        one = lambda p, letters, roles: F.when(p.isNotNull(), F.struct((p["cost"] + costs.insert * len(letters)).alias("cost"), F.concat(p["audit"], F.lit(letters)).alias("audit"), p["path"].alias("path"), F.lit(roles).alias("end")))
        return F.least(one(s["nothing"], "", ""), one(s["assistant"], "", ""), one(s["user"], "I", "A"), one(s["system"], "II", "UA"))

    got = whole.withColumn("found", ended(F.aggregate("blocks", start, step)))
    # an array's borders: what two blocks side by side say together
    pairs = F.arrays_zip(F.slice("blocks", F.lit(1), F.size("blocks") - 1).alias("a"), F.slice("blocks", F.lit(2), F.size("blocks") - 1).alias("b"))
    counted = lambda test: F.size(F.filter(F.when(F.size("blocks") > 1, pairs).otherwise(F.filter(pairs, lambda _: F.lit(False))), test))
    apart = counted(lambda p: ~F.concat(p["a"]["last"], p["b"]["first"]).isin("su", "ua", "au"))
    again = counted(lambda p: F.coalesce(p["a"]["last_turn"] == p["b"]["first_turn"], F.lit(False)))
    ways = F.transform("blocks", lambda b, i: F.struct(b["block"].alias("block"), F.get(b["folds"], F.get(F.col("found.path"), i)).alias("fold"), F.get(F.col("found.path"), i + 1).alias("to")))
    roles = lambda w: F.element_at(F.array(*[w["fold"][s]["roles"] for s in STATES]), w["to"] + 1)
    return got.select(
        "conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - (F.col("fresh") - again), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + apart).cast("long").alias("illegal"), "found.cost", "found.audit", F.col("found.end").alias("end"), F.transform(ways, lambda w: F.struct(w["block"].alias("block"), roles(w).alias("roles"))).alias("ways"))


def edited(turns: DataFrame, flags: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, pos and sub (their order), role, text, edit (keep, rerole or insert)."""
    named = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
    blocks = solved.select(F.col("conv_id").alias("c"), F.explode("ways").alias("w")).select("c", F.col("w.block").alias("b"), F.col("w.roles").alias("roles"))
    # where a row's own letter stands: after as many letters of rows as came before it in its block
    placed = flags.select("conv_id", "block", "pos", "at").join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    own = placed.select("conv_id", "pos", F.get(F.regexp_extract_all("roles", F.lit("[UA]*[kua-]"), F.lit(0)), F.col("at").cast("int")).alias("letters"))
    kept = own.filter("letters <> '-'").select(F.col("pos").alias("p"), "letters")
    met = turns.select("conv_id", "pos", "role", "text").join(kept, F.col("pos") == F.col("p"))
    each = met.select("conv_id", "pos", "role", "text", F.posexplode(F.split("letters", "")).alias("sub", "letter")).filter("letter not in ('', '-')")
    role = F.when(F.col("letter") == "k", F.col("role"))
    for letter, name in named.items():
        role = role.when(F.col("letter") == letter, name)
    made = F.col("letter").isin("U", "A")
    rows = each.select("conv_id", "pos", "sub", role.alias("role"), F.when(made, "").otherwise(F.col("text")).alias("text"), F.when(made, "insert").when(F.col("letter") == "k", "keep").otherwise("rerole").alias("edit"))
    end = solved.filter("end <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("pos"), F.posexplode(F.split("end", "")).alias("sub", "letter")).filter("letter <> ''")
    return rows.unionByName(end.select("conv_id", "pos", "sub", F.when(F.col("letter") == "U", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit("insert").alias("edit")))


def repair(conversations: DataFrame, stage: Stage, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """(report, rows): a row for each conversation with its faults, cost and audit; and the repaired rows, in order of pos and sub.

    Rows are taken by turn, null turns first, equal turns by role and text; null roles and texts
    are empty; rows without conv_id are one conversation. A row with an empty role can't be kept
    as it is. A row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated. Of edits that cost the same the least audit in ASCII is taken. Other columns are
    ignored; an empty table gives no rows. Costs must be positive.
    """
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = ordered(clean, stage)
    flags = stage.write(flagged(turns), "flags")
    solved = stage.write(composed(folded(flags, stage, costs), costs), "solved")
    for name in ("blocks", "folds"):
        stage.drop(name)
    return solved.drop("ways", "end"), edited(turns, flags, solved)


def hashed(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of ``role:text`` of repaired rows, newline-joined.

    A digest is sequential, so a conversation's rows stream through one task, sorted; none is held.
    """

    def run(batches):
        import pyarrow as pa

        names, digests = [], []
        conv, digest = None, None
        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        names.append(conv)
                        digests.append(digest.hexdigest())
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if len(names) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests)], names=["c", "repaired_sha256"])
                names, digests = [], []
        if digest is not None:
            names.append(conv)
            digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests)], names=["c", "repaired_sha256"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "role", "text").mapInArrow(run, "c long, repaired_sha256 string")


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The digest result: one row for each conv_id of ``conversations``, after the trial's damage and its repair."""
    stage = Stage(conversations.sparkSession, "op11")
    report, rows = repair(damaged(conversations), stage)
    digests = stage.write(hashed(rows), "digests")
    every = conversations.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("rows")).drop("rows")
    full = every.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(digests, F.col("id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
