"""WARC round trips, at every place a file can be cut."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc
from ledgerlens.llm.common import Scratch
from ledgerlens.session import new_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(n=12):
    rng = random.Random(3)
    out = []
    for i in range(n):
        # Stored or packed, payloads hold the magic and whole members.
        payload = rng.randbytes(rng.randrange(2000)) + warc.GZIP_MAGIC * 3 + gzip.compress(b"WARC/1.1\r\nno") + b"\r\n\r\n"
        out.append(warc.encode_record(i, f"http://x/{i} \n", payload, digest(payload), None if i % 3 else 7))
    return out


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**6])
def test_each_record_comes_once_however_a_file_is_cut(split):
    packed = records()
    data = b"junk\x1f\x8b\x08" + packed[0] + b"\x1f\x8b" + b"".join(packed[1:])
    found = [
        m.head["WARC-Record-ID"]
        for start in range(0, len(data), split)
        for m in warc.scan_members(io.BytesIO(data), start, min(start + split, len(data)))
    ]
    assert found == [f"<urn:page:{i}>" for i in range(len(packed))]


def test_whole_archive_is_plain_gzip():
    text = gzip.decompress(b"".join(records(3)))
    assert text.count(b"WARC/1.1\r\nWARC-Type") == 3


def test_long_records_and_windows(monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", 64)
    packed = records(6)
    data = b"".join(packed)
    found = [m for s in range(0, len(data), 500) for m in warc.scan_members(io.BytesIO(data), s, min(s + 500, len(data)))]
    assert len(found) == 6


def through_spark(spark, pages, min_bytes=0, split=100):
    folder = new_path(spark, "archives")
    files, _ = Scratch(spark, "t").save(warc.write_archives(warc.mark_revisits(pages, min_bytes), folder))
    return warc.read_archives(spark, files, folder, split)


def expected(rows, min_bytes=0):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= min_bytes:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in payloads:
        other = p in first and first[p] != i
        out.append((i, len(p), digest(p), "revisit" if other else "response", first[p] if other else None))
    return Counter(out)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "é<p>"), (8, "é<p>"), (8, "é<p>"), (None, "é<p>"), (None, "q"), (None, "q"), (1, "x" * 3_000_000), (-4, "\r\n\r\n"), (6, "ab"), (2, "ab")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumns(
        {"url": F.when(F.col("page_id") != 5, "http://a b/\n\r\nX: y"), "payload": F.lit(1), "_n": F.lit(2)})
    for least in (0, 3):
        found = through_spark(spark, pages, least).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == expected(rows, least)
        assert all(r["payload"].decode() in {h or "" for _, h in rows} for r in found if r["record_type"] == "response")
    assert through_spark(spark, pages.limit(0)).count() == 0


def test_whole_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "html").collect()]
    found = through_spark(spark, pages, split=5000).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == expected(rows)
