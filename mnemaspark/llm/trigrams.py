"""Boolean trigram queries that every match of a regular expression must satisfy.

A pattern is walked once. For each part the set of strings it can match exactly is kept
while it stays small; where it grows or ends in a repetition, the runs of characters known
so far are closed. Alternatives stay apart, so a query is a disjunction of conjunctions of
trigrams. All is in lower case, as the index folds case. A pattern with an alternative that
demands no trigram has no query: its rule must scan every text.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser as P

MAX_STRINGS = 16
MAX_CLASS = 8

# An alternative: (closed runs, the run still open at its right end, open at its left end)
Alt = tuple[frozenset[str], str]


def _class(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is C.LITERAL:
            found.add(chr(value).lower())
        elif kind is C.RANGE and value[1] - value[0] < 64:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(found) > MAX_CLASS:
            return None
    return found


def _closed(alts: list[Alt]) -> list[Alt]:
    return [(runs | {run}, "") for runs, run in alts]


def _step(alts: list[Alt], node) -> list[Alt]:
    kind, value = node
    if kind is C.LITERAL:
        return [(runs, run + chr(value).lower()) for runs, run in alts]
    if kind is C.IN and (chars := _class(value)) and len(alts) * len(chars) <= MAX_STRINGS:
        return [(runs, run + c) for runs, run in alts for c in sorted(chars)]
    if kind is C.SUBPATTERN:
        return _walk(alts, value[3])
    if kind is C.BRANCH:
        return [x for branch in value[1] for x in _walk(alts, branch)]
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        if (least, most) == (0, 1):
            both = [*alts, *_walk(alts, inner)]
            return both if len(both) <= MAX_STRINGS else _closed(alts)
        for _ in range(min(least, 3)):
            alts = _walk(alts, inner)
        return alts if least == most <= 3 else _closed(alts)
    if kind is C.AT:
        return alts
    return _closed(alts)


def _walk(alts: list[Alt], pattern) -> list[Alt]:
    for node in pattern:
        alts = _step(alts, node)
    return alts


def query(pattern: str) -> list[frozenset[str]] | None:
    """The trigrams of each alternative, or None if some alternative demands none."""
    tree = P.parse(pattern)
    out = set()
    for runs, _ in _closed(_walk([(frozenset(), "")], tree)):
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams or any(ord(c) > 127 for g in grams for c in g):
            return None
        out.add(grams)
    least = [a for a in out if not any(b < a for b in out)]
    return sorted(least, key=sorted)
