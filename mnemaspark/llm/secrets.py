"""Secret scans by a trigram inverted index.

Each rule is a regular expression. Its Boolean trigram query (``trigrams.query``) names what
a text must hold to match at all. The index has a posting (trigram, doc_id) for every
trigram that some query asks for; postings are intersected for each alternative of a rule,
and only the documents left are verified with the expression itself. Rules without
mandatory trigrams are verified on every document.

All of it is DataFrame functions: no Python runs on the executors. The postings of one
document are merged before they are shuffled, so a frequent trigram gathers nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without
from .trigrams import query


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: a match whose group is shorter is dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Patterns and lengths fixed by the contract of the digest query. Where a whole match is a
#: run of one class, the least length stands in the pattern: a shorter run can't match then.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + ADDED
#: What redaction uses: a private key from its header to the END line or, where that is missing, to
#: the end of its base64 lines (line breaks may be escaped). The digest query lists RULES.
_BREAK = r"(?:\s|\\[rn])"
_KEY = (
    r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]{0,32}PRIVATE KEY-----"
    rf"|(?:{_BREAK}{{0,4}}[A-Za-z0-9-]{{1,32}}: [^\r\n\\]*){{0,8}}(?:{_BREAK}{{0,16}}[A-Za-z0-9+/=]{{16,}}){{0,512}}(?:{_BREAK}{{1,4}}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={_BREAK}*$|\s*\n))?)"
)
WHOLE = tuple(Rule(r.kind, _KEY) if r.kind == "private_key" else r for r in RULES)
SPAN = "struct<start:int,at:int,end:int,kind:string>"


def candidates(docs: DataFrame, rules=RULES) -> tuple[DataFrame, dict[str, Column]]:
    """(doc_id, grams) from the index, and for each indexed rule its test on ``grams``.

    ``grams`` has a bit for each trigram of the index; a rule's test is the intersection of
    the postings of one alternative, joined by or.
    """
    queries = {r.kind: query(r.pattern) for r in rules}
    names = sorted({g for q in queries.values() for alt in q or () for g in alt})
    folded = docs.select("doc_id", F.lower("text").alias("low"))
    postings = folded.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(names)]))).alias("gram"))
    bits = [F.expr(f"bit_or(CASE WHEN gram div 60 = {w} THEN shiftleft(1L, gram % 60) ELSE 0L END)").alias(f"g{w}") for w in range(-(-len(names) // 60))]
    index = postings.groupBy("doc_id").agg(*bits)
    at = {g: divmod(i, 60) for i, g in enumerate(names)}

    def has(alt: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for g in alt:
            w, b = at[g]
            masks[w] = masks.get(w, 0) | 1 << b
        return reduce(lambda x, y: x & y, [F.col(f"g{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items()])

    return index, {k: reduce(lambda x, y: x | y, map(has, q)) for k, q in queries.items() if q}


def _spans(rule: Rule, at: int) -> Column:
    """Spans of a rule's matches in code points, end exclusive.

    The expression splits the text; lengths of pieces and matches, summed in order, give
    the offsets that the built-in functions don't return.
    """
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    pieces = F.split("text", rule.pattern, -1)
    lengths = F.arrays_zip(
        F.transform(found, F.length).alias("m"), F.transform(pieces, F.length).alias("p"),
        (F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.least else F.transform(found, F.length)).alias("g"),
    )
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc, x):
        begin = acc["pos"] + x["p"]
        end = begin + F.coalesce(x["m"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(at).alias("at"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["m"].isNotNull() & (x["g"] >= rule.least)
        return F.struct(end.alias("pos"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lengths, start, add, lambda acc: acc["out"])


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with ``secrets``: its spans (start, at, end, kind) by start, then rule order.

    Null and empty texts have none. Rows with equal doc_ids are indexed together and
    verified each on its own; rows without doc_id are verified without the index. A column
    named secrets is replaced.
    """
    index, tests = candidates(docs, rules)
    index = index.select(F.col("doc_id").alias("op9_id"), *[t.alias(f"op9_{k}") for k, t in tests.items()])
    index = index.filter(reduce(lambda x, y: x | y, [F.col(f"op9_{k}") for k in tests]))
    kept = without(docs, "secrets")
    joined = kept.join(index.hint("shuffle_hash"), kept["doc_id"] == index["op9_id"], "left")
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for i, r in enumerate(rules):
        # hex runs and the like have no cheaper test than their own pattern
        hit = (F.coalesce(F.col(f"op9_{r.kind}"), F.lit(False)) | F.col("doc_id").isNull()) if r.kind in tests else F.lit(True)
        found.append(F.when(hit & F.col("text").rlike(r.pattern), _spans(r, i)).otherwise(none))
    return joined.withColumn("secrets", F.array_sort(F.concat(*found))).select(*[F.col(f"`{c}`") for c in kept.columns], "secrets")


def redact(scanned: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``scanned`` with the text between the spans kept and every run of spans replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def add(acc, s):
        fresh = s["start"] >= acc["pos"]
        gap = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("secrets", start, add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    return scanned.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text")))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``docs``."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["at"] < len(BASE))
    counts = [F.size(F.filter("secrets", _of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
