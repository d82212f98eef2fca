"""Byte-level BPE encoding and decoding as DuckDB queries, run inside each partition.

Encoding: the text is cut by the tokenizer's pattern, and every word not met before becomes
rows (word, position, token), a token for each byte. A recursive query joins neighbouring
tokens with the merge table, finds each word's leftmost pair of least rank, contracts it, and
ends when no word has a pair left. Decoding joins token rows with the vocabulary and
aggregates their bytes in order of position.

The merge table holds every (left, right) of tokens whose bytes joined are a token; the rank
of that token is the rank of the pair.

A word of over ``WINDOW`` bytes is given to the query as windows that overlap by half. Tokens
are those of the whole word just where each pair of neighbours, encoded alone, stays as it is
(a contraction inside a stretch happens in the stretch alone as well, as long as none has
crossed its ends). So windows are joined where both have a boundary with an equal token
beside it; where they have none, a window is started at a boundary of what is known, and
enlarged until they meet. The work is in proportion to the length of the word.

Documents are never shuffled. A worker keeps at most ``MEMO`` encoded words and hands DuckDB
at most ``BATCH_BYTES`` of new words or ``BATCH_TOKENS`` tokens at once; longer texts go
through in pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import Memo, append, worker_model

MEMO = 1_000_000
WINDOW = 256
#: Words up to this go to the query apart from longer ones, which take more steps.
SHORT = 32
BATCH_BYTES = 1 << 18
#: Rows that a query gathers: a word of n bytes has up to n * n / 2.
BATCH_ROWS = 1 << 22
BATCH_TOKENS = 1 << 18

#: Letters of one code block: here \\w, \\s and \\p classes of all engines agree.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SIMPLE = re.compile(rf"[\x00-\x1b\x20-\x7f{_LETTERS}]*").fullmatch
#: For known patterns an equivalent on such texts.
PLAIN = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": re.compile(
        rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"
    ).findall
}

#: A row is (word, position, position and token of its right neighbour, token). The row right
#: of the contracted pair takes its left row's place; words without a pair left are done.
_ENCODE = """
WITH RECURSIVE state(w, pos, nxt_pos, tok, nxt, done) AS (
    SELECT w, pos, pos + 1, tok, nxt, false FROM start
    UNION ALL
    (
        WITH ranked AS (
            SELECT s.*, m.id FROM state s LEFT JOIN merges m ON m.pair = s.tok * 131072::BIGINT + s.nxt WHERE NOT s.done
        ), least AS (
            SELECT w, min(k) AS k, min(k) >> 32 AS best, min(k) & 4294967295 AS p, arg_min(nxt_pos, k) AS q
            FROM (SELECT w, nxt_pos, (id::BIGINT << 32) + pos AS k FROM ranked) GROUP BY w
        )
        SELECT w, CASE WHEN r.pos = q THEN p ELSE r.pos END, r.nxt_pos, CASE WHEN r.pos = q THEN best ELSE r.tok END,
               CASE WHEN r.nxt_pos = p THEN best ELSE r.nxt END, k IS NULL
        FROM ranked r JOIN least USING (w) WHERE k IS NULL OR r.pos <> p
    )
)
SELECT w, tok FROM state WHERE done ORDER BY w, pos
"""

_DECODE = "SELECT doc, array_to_string(list(v.txt ORDER BY pos), '') AS txt FROM ids JOIN vocab v ON v.id = ids.id GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """A DuckDB session with the merge and vocabulary tables of one rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import pyarrow as pa
        import regex

        find, plain = regex.compile(pattern).findall, PLAIN.get(pattern)
        # the same cuts by a faster engine where the classes of both agree
        self._cut = (lambda t: plain(t) if _SIMPLE(t) else find(t)) if plain else find
        ranks = read_ranks(path)
        triples = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, joined = (np.array(c, dtype=np.int32) for c in zip(*triples, strict=True))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = pa.table({"pair": left.astype(np.int64) * 131072 + right, "id": joined})  # noqa: F841
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "txt": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.length[list(ranks.values())] = [len(t) for t in ranks]
        self.memo = Memo(self._learn, MEMO)

    def _query(self, some: list[bytes]) -> list[bytes]:
        """Encodings of stretches of bytes, all in one query."""
        import pyarrow as pa

        sizes = np.array([len(w) for w in some])
        tok = self.byte_id[np.frombuffer(b"".join(some), dtype=np.uint8)]
        stops = np.cumsum(sizes)
        nxt = np.append(tok[1:], -1).astype(np.int32)
        nxt[stops - 1] = -1
        self.db.register("start", pa.table({"w": np.repeat(np.arange(len(some), dtype=np.int32), sizes), "pos": (np.arange(len(tok)) - np.repeat(stops - sizes, sizes)).astype(np.int32), "tok": tok, "nxt": nxt}))
        got = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("start")
        cuts = (4 * np.searchsorted(got.column("w").to_numpy(), np.arange(len(some) + 1))).tolist()
        raw = got.column("tok").to_numpy().astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _encoded(self, some: list[bytes]) -> list[bytes]:
        """Encodings of stretches, ``BATCH_BYTES`` or ``BATCH_ROWS`` of them at once."""
        out: list[bytes] = []
        batch, size, rows = [], 0, 0
        for w in some:
            if batch and (size + len(w) > BATCH_BYTES or rows + len(w) * len(w) // 2 > BATCH_ROWS):
                out += self._query(batch)
                batch, size, rows = [], 0, 0
            batch.append(w)
            size += len(w)
            rows += len(w) * len(w) // 2
        return out + (self._query(batch) if batch else [])

    def _learn(self, words: list[str]) -> list[bytes]:
        """Encodings of words not met before."""
        raw = [w.encode() for w in words]
        made: dict[int, bytes] = {}
        for some in ([i for i, w in enumerate(raw) if len(w) <= SHORT], [i for i, w in enumerate(raw) if SHORT < len(w) <= WINDOW]):
            made.update(zip(some, self._encoded([raw[i] for i in some]), strict=True))
        return [made[i] if i in made else self._long(w) for i, w in enumerate(raw)]

    def _long(self, raw: bytes) -> bytes:
        """The encoding of a word of more than ``WINDOW`` bytes, from windows."""
        starts = range(0, len(raw) - WINDOW // 2, WINDOW // 2)
        windows = [np.frombuffer(x, "<u4") for x in self._encoded([raw[a : a + WINDOW] for a in starts])]
        ids = windows[0]
        ends = np.cumsum(self.length[ids])
        for start, window in zip(starts[1:], windows[1:], strict=True):
            stop, size = min(start + WINDOW, len(raw)), WINDOW
            while ends[-1] < stop:
                joined = self._joined(ids, ends, window, start)
                if joined is not None:
                    ids = joined
                    ends = np.cumsum(self.length[ids])
                    continue
                k = int(np.searchsorted(ends, ends[-1] - size // 2, "right"))
                start = int(ends[k - 1]) if k else 0
                window = np.frombuffer(self._query([raw[start : start + size]])[0], "<u4")
                size *= 2
        return ids.tobytes()

    def _joined(self, ids: np.ndarray, ends: np.ndarray, window: np.ndarray, start: int) -> np.ndarray | None:
        """Tokens of a word's beginning and of a window at ``start`` as one, if they meet and the window reaches further."""
        theirs = start + np.cumsum(self.length[window])
        if theirs[-1] <= ends[-1] or start == 0:
            return None if start else window
        first = int(np.searchsorted(ends, start, "right"))
        _, i, j = np.intersect1d(ends[first:-1], theirs[:-1], assume_unique=True, return_indices=True)
        i = i + first
        for k in np.flatnonzero((ids[i] == window[j]) | (ids[i + 1] == window[j + 1]))[:1]:
            return np.concatenate([ids[: i[k] + 1], window[j[k] + 1 :]])
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        self.memo.learn(set().union(*cut))
        return [b"".join(map(self.memo.get, ws)) for ws in cut]

    def decode(self, encoded: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(index, bytes) of each run of ids; an encoding over ``BATCH_TOKENS`` comes in pieces, in order."""
        import pyarrow as pa

        def run(jobs: list[tuple[int, np.ndarray]]):
            sizes = [len(ids) for _, ids in jobs]
            ids = pa.table({"doc": np.repeat(np.arange(len(jobs), dtype=np.int32), sizes), "pos": np.arange(sum(sizes), dtype=np.int32), "id": np.concatenate([x for _, x in jobs])})
            self.db.register("ids", ids)
            got = dict(zip(*(c.to_pylist() for c in self.db.sql(_DECODE).to_arrow_table().columns), strict=True))
            self.db.unregister("ids")
            for i, (doc, _) in enumerate(jobs):
                yield doc, got[i].encode("latin-1")

        jobs, size = [], 0
        for doc, raw in enumerate(encoded):
            whole = np.frombuffer(raw, dtype="<u4").astype(np.int32)
            for i in range(0, len(whole), BATCH_TOKENS):
                jobs.append((doc, whole[i : i + BATCH_TOKENS]))
                size += len(jobs[-1][1])
                if size >= BATCH_TOKENS:
                    yield from run(jobs)
                    jobs, size = [], 0
        if jobs:
            yield from run(jobs)


def codec(path: str, pattern: str) -> Codec:
    return worker_model(("bpe", path, pattern), lambda: Codec(path, pattern))


def _pieces(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), no special tokens. Null and empty texts have none; a column ids is replaced."""

    def run(batch):
        import pyarrow as pa

        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        made = [np.frombuffer(ids, "<u4").astype(np.int32) for some in _pieces(texts) for ids in codec(path, pattern).encode(some)]
        ends = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*made, np.array([], np.int32)])))]

    return append(docs, "ids array<int>", run)


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` with ``decoded`` (binary), the bytes of ``ids``; null ids give no bytes. A column decoded is replaced."""

    def run(batch):
        import pyarrow as pa

        ids = [np.array(x or [], dtype="<u4").tobytes() for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
        out: list[list[bytes]] = [[] for _ in ids]
        for i, raw in codec(path, pattern).decode(ids):
            out[i].append(raw)
        return [pa.array([b"".join(x) for x in out], pa.binary())]

    return append(rows, "decoded binary", run)


def _digests(keep_ids: bool, path: str, pattern: str):
    def run(batch):
        import pyarrow as pa

        texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        n, ids_hash, decoded_hash, kept = [], [], [], []
        for some in _pieces(texts):
            ids = codec(path, pattern).encode(some)
            hashes = [hashlib.sha256() for _ in some]
            for i, raw in codec(path, pattern).decode(ids):
                hashes[i].update(raw)
            n += [len(x) // 4 for x in ids]
            ids_hash += [hashlib.sha256(x).hexdigest() for x in ids]
            decoded_hash += [h.hexdigest() for h in hashes]
            if keep_ids:
                kept += ids
        columns = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
        if keep_ids:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))))
        return columns

    return run


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest result: one row for each row of ``docs``; ids and decoded bytes don't leave the worker."""
    return append(docs.select("doc_id", "text"), _DIGESTS, _digests(False, path, pattern), ("text",))


def bpe_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (array<int>) of every row, encoded and decoded in one pass."""
    return append(docs.select("doc_id", "text"), _DIGESTS + ", ids array<int>", _digests(True, path, pattern), ("text",))
