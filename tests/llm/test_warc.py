"""Archives of pages: round trips, copies, damage, the same bytes again."""

import base64
import gzip
import hashlib
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from mnemaspark.llm import warc
from mnemaspark.llm.common import Stage

SCHEMA = "page_id long, url string, html string, digest string, payload int, shard string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(6)
    html = ["<p>" + "".join(rng.choices("abcé\n ", k=rng.randint(1, 300))) for _ in range(12)]
    rows = [(i, f"http://e.x/{i}?q=ü x\r\nX: y", rng.choice(html), "c", 1, "c") for i in range(80)]
    rows += [(100, None, None, "c", 1, "c"), (101, "", "", "c", 1, "c"), (None, "u", html[0], "c", 1, "c"), (None, "u", "alone", "c", 1, "c"), (7, "twice", "two", "c", 1, "c"), (7, "other", "three", "c", 1, "c"), (102, "long", "é" * 3_000_000, "c", 1, "c")]
    rows += [(200, "same", "copy", "c", 1, "c")] * 4 + [(None, "same", "nobody", "c", 1, "c")] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def wanted(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    best, out = {}, []
    for r in rows:
        body = (r["html"] or "").encode()
        k = (r["page_id"] is not None, r["page_id"] or 0, r["url"] or "")
        if len(body) >= least:
            best[body] = max(best.get(body, k), k)
    taken = set()
    for r in rows:
        body = (r["html"] or "").encode()
        k = (r["page_id"] is not None, r["page_id"] or 0, r["url"] or "")
        full = len(body) < least or (k == best[body] and body not in taken)
        taken |= {body} if full else set()
        out.append((r["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if full else "revisit", None if full else (best[body][1] if best[body][0] else None)))
    return sorted(out, key=repr)


def test_every_page_comes_back(spark, pages):
    rows = pages.collect()
    assert sorted(map(tuple, warc.warc_digest(pages).collect()), key=repr) == wanted(rows)
    empty = warc.warc_digest(pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_payloads_limits_and_rolls(spark, pages):
    stage = Stage(spark, "t")
    folder = stage.path("out")
    listed = warc.write(pages, folder, stage, shards=3, roll=600, least=5).collect()
    back = warc.read(spark, folder, payloads=True).collect()
    rows = pages.collect()
    got = sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back], key=repr)
    assert got == wanted(rows, 5)
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == {(r["html"] or "").encode() for r in rows}
    assert sum(r["records"] for r in listed) == len(rows) and max(r["file"] for r in listed) > 0
    # all but the last file of a shard has reached the limit, and no file goes on beyond it
    for r in listed:
        if any((x["shard"], x["file"]) == (r["shard"], r["file"] + 1) for x in listed):
            assert r["bytes"] >= 600
    ids = [(r["shard"], r["file"]) for r in listed]
    assert len(set(ids)) == len(ids)
    stored = {p.name: p for p in pathlib.Path(folder.removeprefix("file://")).glob("*.warc.gz")}
    assert set(stored) == {r["name"] for r in listed} and not (pathlib.Path(folder.removeprefix("file://")) / "_temporary").exists()
    first = gzip.decompress(stored[min(stored)].read_bytes())
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\nX: y" not in first


def test_the_same_rows_give_the_same_bytes(spark, pages):
    sums = []
    for parts in (1, 7):
        stage = Stage(spark, "t")
        sums.append(sorted((r["name"], r["records"], r["bytes"], r["sha256"]) for r in warc.write(pages.repartition(parts), stage.path("out"), stage, shards=4, roll=5000).collect()))
    assert sums[0] == sums[1] and len(sums[0]) >= 4


def test_nothing_is_read_that_was_not_committed(spark, pages):
    stage = Stage(spark, "t")
    folder = stage.path("out")
    warc.write(pages.limit(20), folder, stage, shards=2)
    parts = stage.read("parts")
    warc.commit(parts, folder)  # again, as after a lost driver
    assert warc.read(spark, folder).count() == 20
    at = pathlib.Path(folder.removeprefix("file://"))
    name = parts.orderBy(F.desc("bytes")).first()["name"]
    whole = (at / name).read_bytes()
    for damaged in (whole[:-30], whole + whole[-40:], whole[:200] + bytes([whole[200] ^ 1]) + whole[201:]):
        (at / name).write_bytes(damaged)
        with pytest.raises(Exception):
            warc.read(spark, folder).count()
    (at / name).unlink()
    with pytest.raises(Exception):
        warc.commit(parts, folder)
