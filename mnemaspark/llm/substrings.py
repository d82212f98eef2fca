"""Exact substring dedup: bytes covered by a 50-byte string that starts in an earlier document.

Suffixes are sorted blockwise, by way of a difference cover. Places whose number modulo
``PERIOD`` is in ``COVER`` are the sample: any two places of any two documents meet the sample
together after the same number of bytes, at most ``SPREAD``, so two equal 50-byte strings hold
two sampled places at equal distances, with the same ``GRAM`` bytes after them. A bucket is the
sampled suffixes that begin with the same ``GRAM`` bytes.

1. The buckets are dealt into ``BLOCKS`` blocks, made one after another: a block's suffixes
   are gathered, and its files are gone before the next one begins, so disk is bounded by a
   block and memory by a part of one.
2. Ranks of the cover sample settle long ties. A sampled place has a context, the at most 80
   bytes that any 50-byte string around it reaches, and places of equal contexts have one rank
   in their bucket. Where an earlier document has a place of the same rank, all strings
   around the place start there too, and nothing more is compared.
3. What is left are different ranks in one bucket: around the ends of repeated passages. Their
   contexts are fetched and sorted, one bucket at a time, by (distance from the place, 50
   bytes), the earliest document of each run of equal strings deciding. Buckets of more than
   ``HOT`` contexts are not brought together: their strings are aggregated to their earliest
   document instead.
4. Decided places go back to the texts, where they become removed bytes.

Places travel packed, by ``slot`` (the name of the row they are in, modulo a prime), and meet the
texts slot by slot. Copies inside a batch are settled before anything is shuffled, so a passage that a
third of all documents share sends one place for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

LENGTH = 50
#: A perfect difference set: every number but 0 is one difference of two members, modulo 31.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
SPREAD = PERIOD - 1  # a string around a place starts at most this far before it
GRAM = LENGTH - SPREAD
BLOCKS = 4
PART_BYTES = 24 << 20
#: Texts are dealt into slots of about half of ``PART_BYTES``; this many at least.
MIN_SLOTS = 64
CHUNK = 1 << 20
HELD = 500_000
HOT = 200_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hashes of any ranges of a byte array, from sums over its prefixes."""

    up, down = _powers(_BASE, 1), _powers(_INVERSE, 1)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Ranges.up) < n:
            Ranges.up, Ranges.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        self.sums = np.zeros(n, dtype=_U)
        np.cumsum(_BYTES[data] * Ranges.up[: n - 1], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * Ranges.down[a]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * Ranges.down[:n]


def sample(data: np.ndarray, ends: np.ndarray, block: int = 0, blocks: int = 1) -> tuple[np.ndarray, ...]:
    """(document, place in it, hash of its gram, hash of its context) of the sampled places of a block.

    ``data`` holds documents one after another, ``ends`` where each ends.
    """
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    # made period by period, so that nothing but the hashes is as long as the texts
    periods = np.where(size >= LENGTH, (size - GRAM) // PERIOD + 1, 0)
    doc = np.repeat(np.arange(len(ends)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
    pos = (period[:, None] * PERIOD + np.array(COVER)).ravel()
    doc = np.repeat(doc, len(COVER))
    held = pos <= size[doc] - GRAM
    doc, pos = doc[held], pos[held]
    ranges = Ranges(data)
    at = starts[doc] + pos
    gram = _mix(ranges(at, at + GRAM))
    if blocks > 1:
        own = gram % _U(blocks) == _U(block)
        doc, pos, at, gram = doc[own], pos[own], at[own], gram[own]
    a, b = np.maximum(starts[doc], at - SPREAD), np.minimum(ends[doc], at + LENGTH)
    context = _mix(_mix(ranges(a, b)) + (at - a).astype(_U) * _U(128) + (b - at).astype(_U))
    return doc, pos, gram, context


def _several(gram: np.ndarray) -> np.ndarray:
    """Where ``gram`` holds a value that occurs more than once."""
    sorted_ = np.sort(gram)
    again = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    if not len(again):
        return np.array([], dtype=np.int64)
    return np.flatnonzero(again[np.minimum(np.searchsorted(again, gram), len(again) - 1)] == gram)


def _chunks(batch) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(bytes, ends, doc_ids, row ids) of whole documents, about ``CHUNK`` bytes at once."""
    texts, ids, rids, size = [], [], [], 0
    for doc, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        raw = (text.as_py() or "").encode()
        if doc is None or len(raw) < LENGTH:
            continue
        texts.append(raw)
        ids.append(doc)
        rids.append(rid)
        size += len(raw)
        if size >= CHUNK:
            yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), ids, rids
            texts, ids, rids, size = [], [], [], 0
    if texts:
        yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), ids, rids


_PACK = "part int, hashes binary, places binary"
_SLOT = "slot int, kind int, data binary"
#: Kinds of rows of a slot, in the order that they are read in: places where all strings are
#: copies, places with a mask of strings that are, places to compare (with their gram), texts.
COPIES, MASKS, ASKED, TEXT = range(4)


def _zip(*columns: np.ndarray) -> bytes:
    """Columns as differences, byte by byte: what is sorted, or repeats another column, takes little."""
    planes = [np.diff(c, prepend=c.dtype.type(0)).view(np.uint8).reshape(len(c), c.itemsize).T for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in planes))


def _unzip(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(k).ravel(), dtype=k))
        at += n * size
    return out


def _sampled(rows: DataFrame, parts: int, block: int) -> DataFrame:
    """Sampled places of a block, packed by part. part -1 - p: places already known to be copies."""

    def run(batches):
        import pyarrow as pa

        def flush(held):
            doc, rid, pos, gram, ctx = (np.concatenate(c) for c in zip(*held, strict=True))
            copy = np.zeros(len(doc), dtype=bool)
            some = _several(gram)
            if len(some):
                order = some[np.lexsort((doc[some], ctx[some], gram[some]))]
                new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (ctx[order][1:] != ctx[order][:-1]))
                copy[order] = doc[order] > doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            out = []
            if copy.any():
                out.append((-1 - int(gram[0] % _U(parts)), b"", _zip(rid[copy], pos[copy])))
            left = np.flatnonzero(~copy)
            part = ((gram[left] >> _U(20)) % _U(parts)).astype(np.int32)
            short = (gram >> _U(32)).astype(np.uint32)  # of one part, this tells buckets apart; where two meet, contexts still differ
            by = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by], prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
                own = left[by[a:b]]
                out.append((int(part[by[a]]), short[own].tobytes() + ctx[own].tobytes(), _zip(doc[own], rid[own], pos[own])))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "hashes", "places"])

        held, size = [], 0
        for b in batches:
            for data, ends, ids, rids in _chunks(b):
                doc, pos, gram, ctx = sample(data, ends, block, BLOCKS)
                held.append((np.array(ids)[doc], np.array(rids)[doc], pos.astype(np.int32), gram, ctx))
                size += len(doc)
                if size > HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return rows.mapInArrow(run, _PACK)


def _by_slot(slots: int, kind: int, rid: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    slot = (rid % slots).astype(np.int32)
    order = np.lexsort((rid, slot))
    cuts = np.flatnonzero(np.diff(slot[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        own = order[a:b]
        yield int(slot[own[0]]), kind, _zip(rid[own], *(c[own] for c in columns))


def _slot_batch(rows: list[tuple]):
    import pyarrow as pa

    slot, kind, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["slot", "kind", "data"])


def _ranked(packed: DataFrame, parts: int, slots: int) -> DataFrame:
    """Places whose rank an earlier document has, and those still to compare, packed by slot."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        for part, own in groupby(rows(), key=lambda r: r[0]):
            if part < 0:
                known = [_unzip(r[2], "i8", "i4") for r in own]
                yield _slot_batch(list(_by_slot(slots, COPIES, *map(np.concatenate, zip(*known, strict=True)))))
                continue
            gram, ctx, places = [], [], []
            for r in own:
                n = len(r[1]) // 12
                gram.append(np.frombuffer(r[1], np.uint32, n))
                ctx.append(np.frombuffer(r[1], _U, n, 4 * n))
                places.append(_unzip(r[2], "i8", "i8", "i4"))
            gram, ctx = np.concatenate(gram), np.concatenate(ctx)
            doc, rid, pos = map(np.concatenate, zip(*places, strict=True))
            del places
            some = _several(gram)
            if not len(some):
                continue
            order = some[np.lexsort((doc[some], ctx[some], gram[some]))]
            g, c, d = gram[order], ctx[order], doc[order]
            new_gram = np.append(True, g[1:] != g[:-1])
            new_rank = new_gram | np.append(True, c[1:] != c[:-1])
            first = np.flatnonzero(new_gram)
            bucket = np.cumsum(new_gram) - 1
            ranks = np.add.reduceat(new_rank.astype(np.int64), first)[bucket]
            copy = d > d[np.maximum.accumulate(np.where(new_rank, np.arange(len(g)), 0))]
            # of several ranks in a bucket, all of one document alone have nothing to fear
            ask = ~copy & (ranks > 1) & (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first))[bucket]
            out = list(_by_slot(slots, COPIES, rid[order[copy]], pos[order[copy]])) if copy.any() else []
            if ask.any():
                out += _by_slot(slots, ASKED, rid[order[ask]], pos[order[ask]], g[ask].astype(np.int64) | part << 32)
            if out:
                yield _slot_batch(out)

    return packed.repartition(parts, F.abs("part")).sortWithinPartitions("part").mapInArrow(run, _SLOT)


class Places:
    """What is known of the rows of a slot: (rid, pos, further column) by kind."""

    FIELDS = {COPIES: ("i8", "i4"), MASKS: ("i8", "i4", "i8"), ASKED: ("i8", "i4", "i8")}

    def __init__(self, packed: list[tuple[int, bytes]]):
        self.by: dict[int, list[np.ndarray]] = {}
        for kind in {k for k, _ in packed}:
            columns = [np.concatenate(c) for c in zip(*[_unzip(d, *self.FIELDS[kind]) for k, d in packed if k == kind], strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            self.by[kind] = [c[order] for c in columns]

    def of(self, kind: int, rid: int) -> list[np.ndarray]:
        if kind not in self.by:
            return [np.array([], dtype=k) for k in self.FIELDS[kind][1:]]
        columns = self.by[kind]
        a, b = np.searchsorted(columns[0], [rid, rid + 1]) if rid < 2**63 - 1 else (np.searchsorted(columns[0], rid), len(columns[0]))
        return [c[a:b] for c in columns[1:]]


def _beside(rows: DataFrame, packed: DataFrame, parts: int, slots: int) -> DataFrame:
    """Rows (with a column op7_rid) and packed places, slot by slot, the places first."""
    texts = rows.withColumn("op7_slot", F.pmod("op7_rid", F.lit(slots)).cast("int")).withColumn("op7_kind", F.lit(TEXT))
    known = packed.select(F.col("slot").alias("op7_slot"), F.col("kind").alias("op7_kind"), F.col("data").alias("op7_data"))
    return texts.unionByName(known, allowMissingColumns=True).repartition(parts, "op7_slot").sortWithinPartitions("op7_slot", "op7_kind", "op7_rid")


def _with_places(batches) -> Iterator[tuple]:
    """(batch of rows with texts, Places) of ``_beside``."""
    slot, held, places = None, [], None
    for b in batches:
        slots, kinds = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("op7_slot", "op7_kind"))
        data = b.column(b.schema.get_field_index("op7_data"))
        text = kinds == TEXT
        cuts = np.flatnonzero(np.append(True, (slots[1:] != slots[:-1]) | (text[1:] != text[:-1]))).tolist() if len(slots) else []
        for a, z in zip(cuts, [*cuts[1:], len(slots)], strict=True):
            if slots[a] != slot:
                slot, held, places = slots[a], [], None
            if not text[a]:
                held += zip(kinds[a:z].tolist(), data.slice(a, z - a).to_pylist(), strict=True)
                continue
            if places is None:
                places, held = Places(held), []
            yield b.slice(a, z - a), places


def _contexts(rows: DataFrame, asked: DataFrame, parts: int, slots: int) -> DataFrame:
    """(gram, rid, doc_id, pos, before, context) of the places asked about."""

    def run(batches):
        import pyarrow as pa

        last = None
        for b, places in _with_places(batches):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                pos, gram = places.of(ASKED, rid)
                if rid == last or not len(pos):
                    continue
                last, raw, n = rid, text.as_py().encode(), len(pos)
                a = np.maximum(pos - SPREAD, 0)
                for column, x in zip(out, (gram, np.full(n, rid), np.full(n, doc), pos, pos - a), strict=False):
                    column.append(x)
                out[5].extend([raw[i:j] for i, j in zip(a.tolist(), (pos + LENGTH).tolist(), strict=True)])
            if out[5]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:5]), pa.array(out[5], pa.binary())], names=["gram", "rid", "doc_id", "pos", "before", "context"])

    both = _beside(rows, asked, parts, slots)
    return both.mapInArrow(run, "gram long, rid long, doc_id long, pos int, before int, context binary")


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after another, and the sizes of its values."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _strings(before: np.ndarray, data: np.ndarray, size: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each distance from the place: (distance, which contexts reach it, where its 50 bytes start, their hashes).

    A context is the ``size`` bytes of ``data`` from ``first``.
    """
    ranges = Ranges(data)
    for back in range(SPREAD + 1):
        has = np.flatnonzero((before >= back) & (before - back + LENGTH <= size))
        if len(has):
            a = first[has] + before[has] - back
            yield back, has, a, _mix(ranges(a, a + LENGTH))


def _in_order(data: np.ndarray, at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal 50-byte strings together, earlier ones first, and where another string begins.

    Strings are sorted by hash and neighbours of equal hash compared; if any differ, by their bytes.
    """
    order = np.argsort(name, kind="stable")
    new = np.append(True, name[order][1:] != name[order][:-1])
    same = np.flatnonzero(~new)
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    if len(same) and (strings[at[order[same]]] != strings[at[order[same - 1]]]).any():
        whole = np.ascontiguousarray(strings[at]).view(f"V{LENGTH}").ravel()
        _, number = np.unique(whole, return_inverse=True)
        order = np.argsort(number, kind="stable")
        new = np.append(True, np.diff(number[order]) != 0)
    return order, new


def _compared(contexts: DataFrame, parts: int, slots: int) -> DataFrame:
    """Places with a mask, packed by slot; bit i: the string that starts i bytes before the place starts in an earlier document."""

    def run(batches):
        def block(held):
            rid, doc, pos, before = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            data, size = np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])
            mask, first = np.zeros(len(rid), dtype=np.int64), np.cumsum(size) - size
            # once by document, so that equal strings of all distances are
            by_doc = np.argsort(doc, kind="stable")
            rid, doc, pos, before, size, first = (c[by_doc] for c in (rid, doc, pos, before, size, first))
            for back, has, at, name in _strings(before, data, size, first):
                order, new = _in_order(data, at, name)
                own = doc[has[order]]
                mask[has[order[own > own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]]]] |= np.int64(1) << np.int64(back)
            hit = np.flatnonzero(mask)
            return _slot_batch(list(_by_slot(slots, MASKS, rid[hit], pos[hit], mask[hit]))) if len(hit) else None

        held, size = [], 0
        for b in batches:
            if not len(b):
                continue
            gram = b.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # whole buckets end here
            for a, z in ((0, cut), (cut, len(b))):
                if a and size > 20_000 or z == len(b) and size > 20_000 and held[-1][0][-1] != gram[-1]:
                    if (made := block(held)) is not None:
                        yield made
                    held, size = [], 0
                if z > a:
                    some = b.slice(a, z - a)
                    held.append((*(some.column(i).to_numpy() for i in range(5)), *_bytes_of(some.column(5))))
                    size += z - a
        if held and (made := block(held)) is not None:
            yield made

    return contexts.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(run, _SLOT)


def _compared_hot(contexts: DataFrame, slots: int) -> DataFrame:
    """The same for buckets too large to bring together, by aggregation over single strings, named by their bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not len(b):
                continue
            rid, doc, pos, before = (b.column(i).to_numpy() for i in range(1, 5))
            data, size = _bytes_of(b.column(5))
            for back, has, at, _ in _strings(before, data, size, np.cumsum(size) - size):
                whole = data[at[:, None] + np.arange(LENGTH)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), back, np.int32)), pa.array([w.tobytes() for w in whole], pa.binary()), pa.array(doc[has]), pa.array(rid[has]), pa.array(pos[has])], names=["back", "string", "doc_id", "rid", "pos"])

    strings = contexts.mapInArrow(run, "back int, string binary, doc_id long, rid long, pos int")
    least = strings.groupBy("back", "string").agg(F.min("doc_id").alias("least"))
    masks = strings.join(least, ["back", "string"]).filter("doc_id > least").groupBy("rid", "pos").agg(F.bit_or(F.expr("shiftleft(1L, back)")).alias("mask"))

    def pack(batches):
        for b in batches:
            if len(b):
                yield _slot_batch(list(_by_slot(slots, MASKS, *(b.column(i).to_numpy() for i in range(3)))))

    return masks.select("rid", "pos", "mask").mapInArrow(pack, _SLOT)


def _removed(n: int, copies: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Boundaries (start, end, start, end ...) of the maximal removed runs of a text of n bytes.

    All strings around ``copies`` go; of those around ``pos``, the ones that ``mask`` has a bit for.
    """
    if not len(copies) and not mask.any():
        return np.array([], dtype=np.int64)
    copies = copies.astype(np.int64)
    which, back = np.nonzero((mask[:, None] >> np.arange(SPREAD + 1)) & 1)
    start = pos[which].astype(np.int64) - back
    starts = np.concatenate([np.maximum(copies - SPREAD, 0), start])
    ends = np.concatenate([np.minimum(copies, n - LENGTH), start]) + LENGTH
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    # a run begins beyond all that begins before it; runs that touch are one
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return np.stack([starts[first], np.append(reach[first[1:] - 1], reach[-1])], axis=1).ravel()


def _named(docs: DataFrame, stage: Stage) -> DataFrame:
    """``docs`` with op7_rid, the name of a row: its doc_id, or a hash of doc_id and text where several rows have that, or none.

    Places travel with the name, so it costs little only where it follows the order of the rows.
    """
    hashed, plain = F.xxhash64("doc_id", "text"), F.col("doc_id").cast("long")
    again = stage.write(docs.groupBy("doc_id").agg(F.count("*").alias("op7_n")).filter("op7_n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("op7_again")), "again")
    if again.isEmpty():
        return docs.withColumn("op7_rid", F.coalesce(plain, hashed))
    return docs.join(again, "doc_id", "left").withColumn("op7_rid", F.when(F.col("op7_again") | F.col("doc_id").isNull(), hashed).otherwise(plain)).drop("op7_again")


def _slots(total: int) -> int:
    """How many slots for ``total`` bytes of texts: a prime number, so that doc_ids in even steps are dealt evenly."""
    n = max(MIN_SLOTS, 2 * (1 + total // PART_BYTES))
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def mark(docs: DataFrame, stage: Stage) -> DataFrame:
    """Every row of ``docs`` beside what is to be removed from it; ``removals`` reads the batches.

    Documents of equal doc_ids don't take from each other; rows without doc_id neither lose
    nor take anything; texts under 50 bytes, empty and null ones lose nothing. Columns that
    begin with op7_ are not kept.
    """
    docs = _named(docs.select(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("op7_")]), stage)
    rows = docs.select("doc_id", "op7_rid", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // PART_BYTES)
    slots = _slots(total)
    found = [stage.write(_ranked(_sampled(rows, parts, block), parts, slots), f"found-{block}", "kind") for block in range(BLOCKS)]
    copies, asked = (reduce(DataFrame.union, [f.filter(f"kind = {kind}").select("slot", "kind", "data") for f in found]) for kind in (COPIES, ASKED))
    contexts = stage.write(_contexts(rows, asked, parts, slots), "contexts")
    for block in range(BLOCKS):
        stage.drop(f"found-{block}/kind={ASKED}")
    # few: each stands for more than HOT contexts, so the contexts need not travel to meet them
    hot = F.broadcast(contexts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram"))
    masks = _compared(contexts.join(hot, "gram", "left_anti"), parts, slots).union(_compared_hot(contexts.join(hot, "gram", "left_semi"), slots))
    masks = stage.write(masks, "masks")
    stage.drop("contexts")
    return _beside(docs, copies.union(masks), parts, slots)


def removals(batches) -> Iterator[tuple]:
    """(batch of rows, [(text or None, bytes of the text, boundaries of the removed runs)]) of ``mark``."""
    for b, places in _with_places(batches):
        out = []
        for rid, text in zip(b.column(b.schema.get_field_index("op7_rid")).to_pylist(), b.column(b.schema.get_field_index("text")), strict=True):
            raw = (text.as_py() or "").encode()
            out.append((text, raw, _removed(len(raw), *places.of(COPIES, rid), *places.of(MASKS, rid))))
        yield b, out


def substring_digest(docs: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``docs``."""
    marked = mark(docs.select("doc_id", "text"), Stage(docs.sparkSession, "op7"))

    def run(batches):
        import pyarrow as pa

        for b, found in removals(batches):
            n, gone, spans, kept = [], [], [], []
            for _, raw, cuts in found:
                hash_, at = hashlib.sha256(), 0
                for a, z in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
                    hash_.update(raw[at:a])
                    at = z
                hash_.update(raw[at:])
                n.append(len(raw))
                gone.append(int((cuts[1::2] - cuts[::2]).sum()))
                spans.append(len(cuts) // 2)
                kept.append(hash_.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character of which a byte is cut goes whole."""
    marked = mark(docs, Stage(docs.sparkSession, "substrings"))
    names = [c for c in docs.columns if not c.startswith("op7_")]

    def run(batches):
        import pyarrow as pa

        for b, found in removals(batches):
            out = []
            for text, raw, cuts in found:
                cuts = cuts.tolist()
                pieces = [raw[a:z] for a, z in zip([0, *cuts[1::2]], [*cuts[::2], len(raw)], strict=True)]
                out.append("".join(p.decode("utf-8", "ignore") for p in pieces) if text.is_valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in names], names=names)

    from pyspark.sql import types as T

    return marked.mapInArrow(run, T.StructType([docs.schema[c] for c in names]))
