"""Corpus -> token-ID files in ascending doc_id order, and back.

One range shuffle of the texts by doc_id orders the corpus; every partition then tokenises
and writes one file in the shared folder. What the driver sees of a file is one row (path,
number of documents and ids), so positions in the whole corpus are sums over files.

The tokenizer drops white space and never joins text across it, so each stretch between
spaces is encoded by the library once and remembered; ``MEMO`` bounds what a worker keeps.
Texts of ASCII and Latin-1 letters, where the normaliser does no more than lower-case, are cut
here as the pre-tokenizer would cut them, and the library's model encodes each piece once.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Stage, worker_model
from .tokenfile import Reader, Writer

MEMO = 800_000
_SPACES = re.compile(r"[ \n\t\r]+")

#: The parts of a tokenizer file that the cut below stands for; another file takes the general way.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LOW = "a-z\u00df-\u00f6\u00f8-\u00ff"
_SIMPLE = re.compile(f"[\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00de{_LOW}]*").fullmatch
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOW}]+|[0-9]|[^\s0-9{_LOW}]+").findall
#: The public byte-to-character table of byte-level BPE: printable bytes stand for themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, as bytes."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = f"<u{width}"
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda _: None
        self.model = self.tokenizer.model
        self.names = [i.to_bytes(width, "little") for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        parts = json.loads(self.tokenizer.to_str())
        fast = parts["normalizer"] == _NORMALIZER and parts["pre_tokenizer"] == _PRE_TOKENIZER
        self.pieces = Memo(self._pieces, MEMO) if fast else None
        self.stretches = Memo(self._stretches, MEMO // 4)

    def _stretches(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        tokenize, names = self.model.tokenize, self.names
        return [b"".join([names[t.id] for t in tokenize(w.encode().decode("latin-1").translate(_BYTE_CHARS))]) for w in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes. New words of all texts are learnt at once."""
        out: list = list(texts)
        simple, other = [], []
        for i, t in enumerate(texts):
            if self.special(t):
                out[i] = self._stretches([t])[0]
            else:
                (simple if self.pieces is not None and _SIMPLE(t) else other).append(i)
        for own, memo, cut in ((simple, self.pieces, lambda t: _CUT(t.lower())), (other, self.stretches, _SPACES.split)):
            words = [cut(texts[i]) for i in own]
            if own:
                memo.learn(set().union(*words))
            for i, ws in zip(own, words, strict=True):
                out[i] = b"".join(map(memo.get, ws))
        return out


def encoder(path: str, width: int) -> Encoder:
    return worker_model(("tokens", path, width), lambda: Encoder(path, width))


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = 1, width: int = 2) -> DataFrame:
    """Writes the token files; a lazy DataFrame with a row for each: part, file, n_docs, n_tokens.

    It must be materialised once (written), as running it writes the files. Attempts write
    files of different names, and only those of successful tasks are in the rows. Null and
    empty texts have ``end_id`` alone (nothing if it is None); null doc_ids come first, equal
    doc_ids are ordered by text; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, writer, sink = encoder(path, width), None, None
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        target, where = _fs(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
        for b in batches:
            for docs_, texts in _pieces(b):
                if writer is None:
                    target.create_dir(where, recursive=True)
                    sink = target.open_output_stream(f"{where}/{name}", compression=None)
                    writer = Writer(sink, width)
                for doc, ids in zip(docs_, encode(texts), strict=True):
                    writer.add(doc, ids + end)
        if writer is not None:
            total = writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.counts)], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    return ordered.mapInArrow(run, "part long, file string, n_docs long, n_tokens long")


def _pieces(batch, chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of a batch, about ``chars`` characters at once."""
    ids, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def open_file(uri: str) -> Reader:
    target, where = _fs(uri)
    source = target.open_input_file(where)
    return Reader(source, source.size())


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; frames are verified on the way.

    ``files`` is the written result of ``write``, one short row for each file.
    """
    base, rows = 0, []
    for r in files.orderBy("part").collect():
        rows.append((r["file"], base))
        base += r["n_tokens"]
    spark = files.sparkSession
    plan = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for uri, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = open_file(uri)
                crc = np.zeros(len(reader.counts), dtype=np.int64)
                for d, ids in reader.pieces():
                    crc[d] = zlib.crc32(ids.tobytes(), int(crc[d]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(reader.doc_ids, pa.int64(), mask=~reader.has_id), pa.array(reader.starts[:-1] + first, pa.int64()),
                    pa.array(reader.counts, pa.int64()), pa.array(crc, pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """The digest result: one row for each row of ``docs``, read back from the files."""
    stage = Stage(docs.sparkSession, "op6")
    return read(stage.write(write(docs, stage.path("files"), path), "written"))
