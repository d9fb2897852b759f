"""Archives written, normalised and read back: exact round trips, damage, awkward pages."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
from pathlib import Path

import pytest

from raterlake.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def local(uri: str) -> Path:
    return Path(uri.removeprefix("file:"))


def pages(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(1).alias(c) for c in ("file", "seq", "archive", "salt", "first", "payload", "offset", "record_id")])
    return df.repartition(3)


def invented(n: int) -> list[tuple]:
    rng = random.Random(n)
    pool = ["x" * 99, "x" * 100, "é" * 50, "short", "", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9, "\r\n\r\n" * 60, "🙂" * 400]
    rows = [(i, rng.choice([f"https://h{i}.example/a?b=c", "bad\r\nurl: x", None]), rng.choice(pool + [f"<p>{rng.random()}</p>" * rng.randint(1, 400), None])) for i in range(n)]
    return rows + [rows[3], rows[5], (None, "u", "x" * 100), (None, None, "only without an id " * 20), (None, None, "only without an id " * 20), (n, "u", "z" * 3_000_000)]


def expected(rows: list[tuple]) -> list[tuple]:
    out, first = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and payload in first
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first[payload] if revisit else None))
        if page_id is not None:
            first.setdefault(payload, page_id)
    return sorted(out, key=str)


def result(df) -> list[tuple]:
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("archive_bytes", [1, 5000, 1 << 27])
def test_pages_come_back(spark, archive_bytes):
    rows = invented(120)
    out = warc.archive_pages(pages(spark, rows, clash=True), archive_bytes)
    assert result(out) == expected(rows)
    texts = {r.page_id: r.payload for r in out.filter("record_type = 'response' and page_id is not null").collect()}
    assert all(texts[i] == (html or "").encode() for i, _, html in rows if i in texts)


def test_each_record_is_a_member_and_the_sidecar_knows_where(spark):
    rows = invented(40)
    raw, whole = common.folder(spark), common.folder(spark)
    records = common.materialise(warc.write_archives(pages(spark, rows), raw, 20_000))
    assert all(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID") >= 1 for f in local(raw).glob("*.gz"))
    index = warc.normalise(warc.duplicates(records), raw, whole).collect()
    assert len(index) == len(rows) and not any(r.problem for r in index)
    for archive in {r.archive for r in index}:
        data = (local(whole) / archive).read_bytes()
        side = [json.loads(x) for x in (local(whole) / f"{archive}.index").read_text().splitlines()]
        mine = sorted((r for r in index if r.archive == archive), key=lambda r: r.offset)
        assert [(x["offset"], x["length"], x["record_id"]) for x in side] == [(r.offset, r.length, r.record_id) for r in mine]
        at = 0
        for x in side:  # members follow each other without a gap, and each is one whole record
            member = gzip.decompress(data[at : at + x["length"]])
            assert x["offset"] == at and member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and x["record_id"].encode() in member
            at += x["length"]
        assert at == len(data)


def test_foreign_archives(spark):
    """One stream, many members, no compression, folded and oddly named fields, records that are no HTTP."""
    raw, whole = common.folder(spark), common.folder(spark)
    record = lambda kind, body, extra=b"": b"WARC/1.0\r\nwarc-type: " + kind + b"\r\nWARC-Record-ID: <r:" + body[:3] + b">\r\n" + extra + b"content-length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    a, b, c = record(b"warcinfo", b"abc: 1\r\n", b"X-Folded: one\r\n two\r\n"), record(b"response", b"def" * 700_000), record(b"metadata", b"ghi\r\n\r\njkl")
    for name, data in (("one.warc.gz", gzip.compress(a + b + c)), ("many.warc.gz", b"".join(map(gzip.compress, (a, b, c)))), ("plain.warc", a + b + c), ("empty.warc.gz", gzip.compress(b"")), ("none.warc", b"")):
        (local(raw) / name).write_bytes(data)
    plan = spark.createDataFrame([(n, None, None, None) for n in ("one.warc.gz", "many.warc.gz", "plain.warc", "empty.warc.gz", "none.warc")], "file string, seq long, refers_to long, refers_record string")
    index = common.materialise(warc.normalise(plan, raw, whole))
    assert sorted((r.file, r.seq, r.record_type) for r in index.collect()) == sorted((n, i, k) for n in ("one.warc.gz", "many.warc.gz", "plain.warc") for i, k in enumerate(("warcinfo", "response", "metadata")))
    found = warc.read_records(index, whole).collect()
    assert sorted(bytes(r.payload) for r in found) == sorted([b"abc: 1\r\n", b"def" * 700_000, b"ghi\r\n\r\njkl"] * 3)


@pytest.mark.parametrize(("damage", "n"), [("cut", 1), ("plain cut", 1), ("flip", 0), ("no length", 1), ("no record", 1)])
def test_damage_is_told_and_whole_records_stay(spark, damage, n):
    raw, whole = common.folder(spark), common.folder(spark)
    rng = random.Random(3)
    body = bytes(rng.randrange(256) for _ in range(300_000))
    head = lambda size: b"WARC/1.1\r\nWARC-Type: resource\r\n" + size + b"\r\n"
    one = head(b"Content-Length: 300000\r\n") + body + b"\r\n\r\n"
    data = {"cut": gzip.compress(one * 2)[:-100_000], "plain cut": (one * 2)[:-100_000], "flip": b"\x1f\x8b" + b"\xff" * 5000, "no length": gzip.compress(one + head(b"") + body), "no record": gzip.compress(one + b"garbage\r\n\r\n")}[damage]
    (local(raw) / "x.warc.gz").write_bytes(data)
    plan = spark.createDataFrame([("x.warc.gz", None, None, None)], "file string, seq long, refers_to long, refers_record string")
    index = common.materialise(warc.normalise(plan, raw, whole))
    rows = index.collect()
    assert sum(r.problem is None for r in rows) == n and sum(r.problem is not None for r in rows) == 1
    assert [bytes(r.payload) for r in warc.read_records(index, whole).collect()] == [body] * n


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
