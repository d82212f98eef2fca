"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark items are normalised to words, every window of 13 words (or the whole of a shorter
item) becomes a key of word numbers in one automaton, and each document's words run through
it once. Hits are word positions; for documents that have any, they are mapped back to
offsets in the original text.

Documents are never shuffled. The automaton is made from benchmark texts of at most
``PART_BYTES``; a larger benchmark is dealt by item into as many automata as needed, each
scanned in turn with the hits of those before it carried along.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append

WINDOW = 13
PART_BYTES = 16 << 20
FIELDS = "n_words long, hit_words array<struct<a:int,b:int>>, items array<string>"

#: Bytes of words: digits, letters in lower case, and all of UTF-8 outside ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at every other ASCII character; null has no words."""
    return (text or "").encode().translate(_FOLD).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Offsets in code points of the words that ``words`` gives, in the same order."""
    return [m.span() for m in _WORD.finditer(text)]


def windows(items: list[tuple[str | None, str | None]]) -> dict[tuple[bytes, ...], set[str]]:
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
            ids = found.setdefault(tuple(own[i : i + WINDOW]), set())
            if item is not None:
                ids.add(item)
    return found


class Matcher:
    """An automaton over word numbers; 0 is every word that no window has."""

    def __init__(self, keys: dict[tuple[bytes, ...], set[str]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.values: list[tuple[int, set[str]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, ids in keys.items():
            numbers = tuple(self.number.setdefault(w, len(self.number) + 1) for w in key)
            self.automaton.add_word(numbers, len(self.values))
            self.values.append((len(key), ids))
        if keys:
            self.automaton.make_automaton()

    def scan(self, own: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Word intervals covered by windows, merged, and the items they are of."""
        spans: list[list[int]] = []
        ids: set[str] = set()
        if not self.values or not own:
            return spans, ids
        number = self.number.get
        for end, value in self.automaton.iter(tuple([number(w, 0) for w in own])):
            size, items = self.values[value]
            ids |= items
            spans.append([end - size + 1, end + 1])
        return merged(spans), ids


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _scanner(items: list[tuple[str | None, str | None]], again: bool):
    made: list[Matcher] = []

    def scan(batch):
        import pyarrow as pa

        if not made:
            made.append(Matcher(windows(items)))
        texts = batch.column(batch.schema.get_field_index("text"))
        before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_words", "items")] if again else None
        n, hits, ids = [], [], []
        for i, text in enumerate(texts):
            own = words(text.as_py())
            spans, found = made[0].scan(own)
            if before:
                spans = merged(spans + [[s["a"], s["b"]] for s in before[0][i]])
                found = found | set(before[1][i])
            n.append(len(own))
            hits.append([{"a": a, "b": b} for a, b in spans])
            ids.append(sorted(found))
        return [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))]

    return scan


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with n_words, hit_words, items, n_hit and contaminated.

    hit_words are intervals of word numbers (end exclusive); ``offsets`` turns them into
    offsets of the text. Null and empty texts have no words and no hits. Items with equal
    ids count as one, items without id hit but are not listed; an empty benchmark hits
    nothing. Columns with these names are replaced, all others pass.
    """
    bench = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    out = docs
    for p in range(parts):
        # about PART_BYTES of text, however large the benchmark is
        own = bench if parts == 1 else bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        out = append(out, FIELDS, _scanner([tuple(r) for r in own.collect()], p > 0))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + (s["b"] - s["a"]).cast("long"))
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def offsets(marked: DataFrame) -> DataFrame:
    """``marked`` with hit_spans: the hit intervals in code points of the original text, end exclusive."""

    def spans(batch):
        import pyarrow as pa

        texts, hits = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "hit_words"))
        out = []
        for text, own in zip(texts, hits, strict=True):
            at = word_spans(text) if own else []
            out.append([{"start": at[s["a"]][0], "end": at[s["b"] - 1][1]} for s in own])
        return [pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    return append(marked, "hit_spans array<struct<start:int,end:int>>", spans)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``docs``."""
    listed = F.array_join("items", ",")
    return mark(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated"
    )


def brute_force(text: str | None, items: list[tuple[str, str]]) -> tuple[int, int, list[str]]:
    """For tests: every window of every item against every position."""
    own, hit, found = words(text), set(), set()
    for item, body in items:
        theirs = words(body)
        for i in range(max(1, len(theirs) - WINDOW + 1) if theirs else 0):
            w = theirs[i : i + WINDOW]
            for j in range(len(own) - len(w) + 1):
                if own[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(item)
    return len(own), len(hit), sorted(found)


def items_hash(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
