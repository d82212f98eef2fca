"""Pages -> WARC archives in the shared folder, and back.

Deterministic: the same rows give the same files, byte for byte. Records are ordered by
(page_id, payload digest, url); a sample of these keys, drawn by hash in proportion to the bytes
behind them, gives quantiles that cut the order into shards; one shuffle brings each shard, sorted,
to one task, which writes its records as members of gzip files and opens the next file when one
has reached ``roll`` compressed bytes. Headers and digests are made anew from the payload.

Tasks write under temporary names; what they report is one short row for each file. The files
of the attempts that Spark kept are then renamed, and last a manifest is put in place with one
rename: archives without a manifest are not read, and running a commit twice does no harm.

Which copy of a payload is written in full is decided on keys and digests alone. A payload
meets its decision in the writing task, so each page travels once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage

DATE = "2024-01-01T00:00:00Z"
ROLL = 256 << 20
SHARD_BYTES, FEWEST, MOST, PER_SHARD = 8 << 20, 64, 4096, 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
LOWEST = -(1 << 63)
PARTS = "shard int, file int, name string, temporary string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"

Key = tuple[int, str]


# ---- one record ---------------------------------------------------------------------------


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def target(url: str) -> str:
    """A URI for a header: bytes other than printable ASCII are percent-encoded; an empty one is about:blank."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in url.encode("utf-8", "replace")) or "about:blank"


def record_id(page: int | None, url: str, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}|{copy}|{url}')}>"


def record(headers: list[tuple[str, str]], block: bytes, payload: bytes = b"") -> bytes:
    """One gzip member: a record of ``headers``, the block's digest and length, and the block, which ends with ``payload``."""
    own = hashlib.sha1(block)
    own.update(payload)
    lines = [*headers, ("WARC-Block-Digest", "sha1:" + base32(own.digest())), ("Content-Length", str(len(block) + len(payload)))]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return b"".join((squeeze.compress(head.encode() + block), squeeze.compress(payload), squeeze.compress(b"\r\n\r\n"), squeeze.flush()))


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _common(kind: str, page: int | None, url: str, digest: str, copy: int, sha1: bytes) -> list[tuple[str, str]]:
    own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, url, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", "sha1:" + base32(sha1))]
    return [*own, *([("X-Page-ID", str(page))] if page is not None else []), ("Content-Type", "application/http;msgtype=response")]


def response(page: int | None, url: str, digest: str, copy: int, payload: bytes) -> bytes:
    return record(_common("response", page, url, digest, copy, hashlib.sha1(payload).digest()), _http(len(payload)), payload)


def revisit(page: int | None, url: str, digest: str, copy: int, sha1: bytes, size: int, first: int | None, first_url: str) -> bytes:
    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, first_url, digest, 0)), ("WARC-Refers-To-Target-URI", target(first_url)), ("WARC-Refers-To-Date", DATE)]
    more += [("X-Refers-To-Page-ID", str(first))] if first is not None else []
    return record([*_common("revisit", page, url, digest, copy, sha1), *more], _http(size))


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip stream, one at a time; lengths and block digests are checked."""
    member, parts, rest = zlib.decompressobj(31), [], b""
    while rest or (rest := stream.read(chunk)):
        parts.append(member.decompress(rest))
        rest = member.unused_data
        if member.eof:
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines)
            block, end = body[:-4], body[-4:]
            if version != "WARC/1.1" or end != b"\r\n\r\n" or len(block) != int(headers["Content-Length"]) or headers["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
                raise ValueError(f"a damaged record: {lines[:2]}")
            yield headers, block
            member, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a file ends within a record")


# ---- which copy, and where ----------------------------------------------------------------


def _keyed(pages: DataFrame) -> DataFrame:
    body = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))


def decisions(keyed: DataFrame, stage: Stage, least: int) -> DataFrame:
    """A row for each (page_id, url, digest): its copies n, whether it is ``full``, and the page that it repeats else.

    Staged. Digests that occur once need no partner; the join on those that occur again is one
    that Spark splits where a digest holds many rows.
    """
    keys = stage.write(keyed.groupBy("page_id", "url", "digest").agg(F.count("*").alias("n"), F.first(F.sha1("payload")).alias("sha1"), F.first(F.octet_length("payload").cast("long")).alias("size")), "keys")
    repeated = keys.filter(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    first = stage.write(repeated.select("digest", "first"), "first")
    own = F.struct("page_id", "url")
    joined = keys.join(first, "digest", "left").withColumn("full", F.col("first").isNull() | F.col("first").eqNullSafe(own))
    return stage.write(joined.select("page_id", "url", "digest", "n", "sha1", "size", "full", F.col("size").__lt__(least).alias("alone"), F.coalesce("first", own).alias("first")), "decisions")


def _key() -> Column:
    return F.struct(F.coalesce("page_id", F.lit(LOWEST)).alias("k"), F.substring("digest", 1, 16).alias("d"))


def cuts(decided: DataFrame, shards: int | None) -> list[Key]:
    """Boundaries of at most ``shards`` parts of about equal bytes; what is sampled is bounded by PER_SHARD for each."""
    weight = F.col("n") * 64 + F.when(F.col("full"), F.col("size")).otherwise(0)
    total = decided.agg(F.sum(weight)).first()[0] or 0
    shards = shards or min(MOST, max(FEWEST, -(-total // SHARD_BYTES)))
    wanted, span = shards * PER_SHARD, 1 << 52
    draw = F.pmod(F.xxhash64("page_id", "digest", "url"), F.lit(span)) / F.lit(float(span))
    got = decided.filter(draw < weight * F.lit(wanted / max(total, 1))).select(_key().alias("key"), F.greatest(weight.cast("double"), F.lit(total / wanted)).alias("w")).collect()
    sample = sorted(((r["key"]["k"], r["key"]["d"]), r["w"]) for r in got)
    whole, seen, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        seen += w
        if len(out) < shards - 1 and seen >= whole * (len(out) + 1) / shards and (not out or key > out[-1]):
            out.append(key)
    return out


def _literals(keys: list[Key]) -> str:
    return "array(" + ", ".join(f"named_struct('k', {f'{k}L' if k > LOWEST else '-9223372036854775807L - 1L'}, 'd', '{d}')" for k, d in keys) + ")"


def _shard(boundaries: list[Key]) -> Column:
    """How many boundaries lie below a row's key, found in two levels of about sqrt(n) each."""
    if not boundaries:
        return F.lit(0)
    key = "named_struct('k', coalesce(page_id, -9223372036854775807L - 1L), 'd', substring(digest, 1, 16))"
    below = lambda keys: F.expr(f"size(filter({_literals(keys)}, s -> s < {key}))")
    step = max(1, int(len(boundaries) ** 0.5))
    groups = [boundaries[i : i + step] for i in range(0, len(boundaries), step)]
    top, out = below([g[-1] for g in groups]), F.lit(len(boundaries))
    for i in reversed(range(len(groups))):
        out = F.when(top == i, F.lit(i * step) + below(groups[i])).otherwise(out)
    return out.cast("int")


# ---- files --------------------------------------------------------------------------------


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Roller:
    """Files of one shard after another; ``roll`` compressed bytes end a file."""

    folder: str
    prefix: str
    roll: int
    done: list[tuple] = field(default_factory=list)
    sink: object = None
    at: tuple[int, int] = (-1, -1)

    def add(self, shard: int, member: bytes) -> None:
        if self.sink is None or shard != self.at[0]:
            self._open(shard, 0)
        elif self.bytes >= self.roll:
            self._open(shard, self.at[1] + 1)
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def _open(self, shard: int, nth: int) -> None:
        self.close()
        store, where = _fs(f"{self.folder}/_temporary")
        store.create_dir(where, recursive=True)
        self.name, self.at = f"{self.prefix}-{shard:05d}-{nth:05d}.warc.gz", (shard, nth)
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        store, where = _fs(f"{self.folder}/{self.temporary}")
        self.sink, self.sha, self.bytes, self.records = store.open_output_stream(where, compression=None), hashlib.sha256(), 0, 0
        about = f"format: WARC File Format 1.1\r\nisPartOf: {self.prefix}\r\n".encode()
        self._put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "", 0)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.done.append((*self.at, self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest()))
            self.sink = None


def _members(row: dict, payload: Callable[[], bytes]) -> Iterator[bytes]:
    """The records of one decision, its copies numbered."""
    sha1, first = bytes.fromhex(row["sha1"]), row["first"]
    for copy in range(row["n"]):
        if row["full"] and (copy == 0 or row["alone"]):
            yield response(row["page_id"], row["url"], row["digest"], copy, payload())
        else:
            yield revisit(row["page_id"], row["url"], row["digest"], copy, sha1, row["size"], first["page_id"], first["url"])


def write(pages: DataFrame, folder: str, stage: Stage, prefix: str = "pages", shards: int | None = None, roll: int = ROLL, least: int = 0) -> DataFrame:
    """Writes and commits the archives of ``pages`` (page_id, url, html); a row for each file.

    Null html is an empty payload, a null or empty url about:blank, a null page_id has no page
    header and comes first. Of rows with equal payloads of at least ``least`` bytes the one with the
    largest page_id (then url) is a response and the others revisits of it; of rows equal in
    all, one is the response. Smaller payloads are responses each. Other columns are ignored; an
    empty table gives an empty manifest.
    """
    keyed = _keyed(pages)
    decided = decisions(keyed, stage, least)
    boundaries = cuts(decided, shards)
    if decided.filter("n > 1").isEmpty():
        bodies = keyed
    else:  # rows equal in all travel as one
        bodies = keyed.groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"))
    known = decided.select("page_id", "url", "digest", F.struct("page_id", "url", "digest", "n", "sha1", "size", "full", "alone", "first").alias("decision"))
    rows = known.unionByName(bodies, allowMissingColumns=True).withColumn("shard", _shard(boundaries))
    dealt = rows.repartitionById(len(boundaries) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "url", F.col("decision").isNull())

    def run(batches):
        import pyarrow as pa

        out, waiting = Roller(folder, prefix, roll), None
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i, (shard, decision) in enumerate(zip(column["shard"].to_pylist(), column["decision"].to_pylist(), strict=True)):
                if decision is not None:
                    waiting = decision if decision["full"] else None
                    if waiting is None:
                        for member in _members(decision, bytes):
                            out.add(shard, member)
                elif waiting is not None:
                    payload = column["payload"][i].as_py()
                    for member in _members(waiting, lambda: payload):  # noqa: B023
                        out.add(shard, member)
                    waiting = None
        out.close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out.done, strict=True), kinds, strict=True)], names=["shard", "file", "name", "temporary", "records", "bytes", "sha256"])

    # written, so that a task that runs again can't name other temporary files
    parts = stage.write(dealt.select("shard", "decision", "payload").mapInArrow(run, PARTS), "parts")
    for name in ("keys", "first", "decisions"):
        stage.drop(name)
    commit(parts, folder)
    return archives(pages.sparkSession, folder)


def commit(parts: DataFrame, folder: str) -> None:
    """Gives the files of ``parts`` their names, then puts the manifest in place; may be run again."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for r in b.to_pylist():
                store, old = _fs(f"{folder}/{r['temporary']}")
                new = _fs(f"{folder}/{r['name']}")[1]
                at, there = store.get_file_info([old, new])
                if at.type == fs.FileType.File:
                    if there.type == fs.FileType.File:
                        store.delete_file(new)
                    store.move(old, new)
                elif there.size != r["bytes"]:
                    raise FileNotFoundError(f"neither {r['temporary']} nor {r['name']} is there")
            yield b

    spark = parts.sparkSession
    done = parts.mapInArrow(run, PARTS).drop("temporary")
    done.write.mode("overwrite").json(f"{folder}/{MANIFEST}.new")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(path(f"{folder}/{MANIFEST}"), True)
    if not store.rename(path(f"{folder}/{MANIFEST}.new"), path(f"{folder}/{MANIFEST}")):
        raise OSError(f"the manifest of {folder} can't be put in place")
    store.delete(path(f"{folder}/_temporary"), True)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of committed archives: shard, file, name, records, bytes, sha256."""
    return spark.read.schema(PARTS.replace("temporary string, ", "")).json(f"{folder}/{MANIFEST}")


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The pages of committed archives: page_id, url, record_type, payload_bytes, payload_digest (base32 of SHA-1), refers_to, and if asked payload.

    Files are checked against the manifest, blocks and payloads against their digests. Of a
    revisit, size and digest are those of the payload that it repeats, which is null here.
    """
    listed = archives(spark, folder)
    plan = listed.select("name", "bytes", "sha256").repartition(max(1, listed.count()), F.hash("name"))

    def rows(name: str, size: int, sha256: str) -> Iterator[dict]:
        store, where = _fs(f"{folder}/{name}")
        seen, whole = 0, hashlib.sha256()

        class Counted:
            def read(self, n):
                nonlocal seen
                data = source.read(n)
                seen += len(data)
                whole.update(data)
                return data

        with store.open_input_stream(where, compression=None) as source:
            for headers, block in records(Counted()):
                kind = headers["WARC-Type"]
                if kind == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
                    raise ValueError(f"{name}: a payload differs from its digest")
                number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                yield {"page_id": number("X-Page-ID"), "url": headers["WARC-Target-URI"], "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}
        if (seen, whole.hexdigest()) != (size, sha256):
            raise ValueError(f"{name} isn't the file of the manifest")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])])
        out, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                for x in rows(r["name"], r["bytes"], r["sha256"]):
                    held += len(x["payload"] or b"") if payloads else 0
                    out.append(x if payloads else {k: v for k, v in x.items() if k != "payload"})
                    if len(out) == 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return plan.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def warc_digest(pages: DataFrame) -> DataFrame:
    """The digest result: one row for each row of ``pages``, read back from the archives."""
    spark = pages.sparkSession
    stage = Stage(spark, "op12")
    write(pages, stage.path("archives"), stage)
    return read(spark, stage.path("archives")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
