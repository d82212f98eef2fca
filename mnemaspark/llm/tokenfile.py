"""Token-ID files: independent zstandard frames, a document index, and a trailing seek table.

A file is a sequence of data frames (each the ids of some whole documents, or a slice of one
very long document), a skippable frame with the document index, and a skippable frame with
the seek table of the public zstandard seekable format: for every data frame its compressed
size, decompressed size and checksum (low 32 bits of XXH64 of the content), then the number
of frames, a descriptor and the magic number. A reader takes the last bytes, the table and
the index, and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import xxhash
import zstandard

FRAME_BYTES = 256 << 10
LEVEL = 3

#: Fixed values of the zstandard seekable format.
SEEK_FRAME = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
SKIPPABLE = struct.Struct("<II")
#: Own document index: a skippable frame of this number, before the seek table.
INDEX_FRAME = 0x184D2A50
INDEX_HEAD = struct.Struct("<4sBQ")
INDEX_MAGIC = b"TIDX"


class Corrupt(ValueError):
    pass


class Writer:
    """Writes documents in the order given. ``width`` is the bytes of an id, 2 or 4."""

    def __init__(self, out: BinaryIO, width: int = 4):
        self.out, self.width = out, width
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.has_id: list[bool] = []
        self.counts: list[int] = []
        self.pending: list[bytes] = []
        self.size = 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` are little-endian unsigned integers of ``width`` bytes."""
        raw = memoryview(ids)
        self.ids.append(0 if doc_id is None else doc_id)
        self.has_id.append(doc_id is not None)
        self.counts.append(len(ids) // self.width)
        for at in range(0, len(raw), FRAME_BYTES):
            piece = raw[at : at + FRAME_BYTES]
            if self.size + len(piece) > FRAME_BYTES:
                self._flush()
            self.pending.append(bytes(piece))
            self.size += len(piece)

    def _flush(self) -> None:
        if self.size:
            raw = b"".join(self.pending)
            packed = self.zip.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> int:
        """Writes index and seek table; the number of ids in the file."""
        self._flush()
        index = INDEX_HEAD.pack(INDEX_MAGIC, self.width, len(self.ids)) + self.zip.compress(
            np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.has_id, "u1").tobytes()
        )
        self.out.write(SKIPPABLE.pack(INDEX_FRAME, len(index)) + index)
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUMS, SEEK_MAGIC)
        self.out.write(SKIPPABLE.pack(SEEK_FRAME, len(table)) + table)
        return sum(self.counts)


class Reader:
    """Random access to the documents of a file; a frame is checked whenever it is read."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        foot = self._read(size - FOOTER.size, FOOTER.size)
        n, flags, magic = FOOTER.unpack(foot)
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise Corrupt("no seek table")
        table_at = size - FOOTER.size - n * ENTRY.size
        if SKIPPABLE.unpack(self._read(table_at - SKIPPABLE.size, SKIPPABLE.size)) != (SEEK_FRAME, n * ENTRY.size + FOOTER.size):
            raise Corrupt("seek table of another size")
        table = np.frombuffer(self._read(table_at, n * ENTRY.size), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.check = table[:, 2]
        index_at = int(self.at[-1])
        kind, length = SKIPPABLE.unpack(self._read(index_at, SKIPPABLE.size))
        index = self._read(index_at + SKIPPABLE.size, length)
        mark, self.width, docs = INDEX_HEAD.unpack_from(index)
        if kind != INDEX_FRAME or mark != INDEX_MAGIC:
            raise Corrupt("no document index")
        self.unzip = zstandard.ZstdDecompressor()
        body = self.unzip.decompress(index[INDEX_HEAD.size :], max_output_size=docs * 17 or 1)
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.counts = np.frombuffer(body, "<u8", docs, docs * 8).astype(np.int64)
        self.has_id = np.frombuffer(body, "u1", docs, docs * 16).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(n)
        if at < 0 or len(got) != n:
            raise Corrupt("file is cut short")
        return bytes(got)

    def frame(self, i: int) -> bytes:
        raw = self.unzip.decompress(self._read(int(self.at[i]), int(self.at[i + 1] - self.at[i])), max_output_size=FRAME_BYTES)
        if len(raw) != self.raw_at[i + 1] - self.raw_at[i] or xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.check[i]:
            raise Corrupt(f"frame {i} fails its checksum")
        return raw

    def pieces(self, ordinals: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(ordinal, ids) of the wanted documents in ascending order, a piece for each frame that one spans."""
        last, raw = -1, b""
        for d in range(len(self.counts)) if ordinals is None else sorted(ordinals):
            a, b = (int(x) * self.width for x in self.starts[d : d + 2])
            i = int(np.searchsorted(self.raw_at, a, "right")) - 1
            if a == b:
                yield d, np.array([], "<u4")
            while a < b:
                if i != last:
                    last, raw = i, self.frame(i)
                base = int(self.raw_at[i])
                upto = min(b, base + len(raw))
                yield d, np.frombuffer(raw[a - base : upto - base], f"<u{self.width}").astype("<u4")
                a, i = upto, i + 1

    def documents(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """Ids of the documents asked for; of repeated doc_ids the last."""
        wanted = set(doc_ids)
        found: dict[int, list[np.ndarray]] = {}
        at = {d: int(self.doc_ids[d]) for d in range(len(self.doc_ids)) if self.has_id[d] and int(self.doc_ids[d]) in wanted}
        own = {doc: d for d, doc in at.items()}
        for d, ids in self.pieces(own.values()):
            found.setdefault(at[d], []).append(ids)
        return {doc: np.concatenate(x) for doc, x in found.items()}
