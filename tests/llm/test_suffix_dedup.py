"""Repeated bytes against a plain count of all windows; merging against sorting."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common
from ledgerlens.llm import suffix_dedup as sd

W = sd.WINDOW


def plain(texts):
    """Per text: (bytes, removed, spans, kept)."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[s : s + W] for d in data for s in range(len(d) - W + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        end = 0
        for s in range(len(d) - W + 1):
            if count[d[s : s + W]] > 1:
                a = max(s, end)
                gone[a : s + W] = b"\x01" * (s + W - a)
                end = s + W
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, kept))
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(90), prose(16)  # over and under the window in bytes
    exact = prose(60).encode()[:W].decode(errors="ignore")
    texts = [prose(rng.randrange(150)) for _ in range(20)]
    for _ in range(12):
        i, j = sorted(rng.randrange(len(passage)) for _ in range(2))
        texts.append(prose(rng.randrange(60)) + passage[i:j] + prose(rng.randrange(60)))
        texts.append(prose(20) + " " + line + " " + prose(20))
        texts.append(prose(10) + exact + prose(10))
    base = prose(120)
    for _ in range(12):  # near copies
        k = rng.randrange(len(base))
        texts.append(base[:k] + "#" + base[k + 1 :])
    texts += [texts[0], texts[0], "a" * 500, "ab" * 150, "x" * W, "x" * (W - 1), "x" * (W + 1), "", None, passage + passage, "\n" * 450]
    return texts


@pytest.mark.parametrize("seed, group, run_bytes", [(1, sd.GROUP, sd.RUN_BYTES), (2, 3, 2000), (3, 8, 3000)])
def test_matches_plain_count(spark, monkeypatch, seed, group, run_bytes):
    monkeypatch.setattr(sd, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(sd, "PER_RANGE", 20 if group != sd.GROUP else sd.PER_RANGE)
    texts = planted(seed)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_ctx": F.lit(1), "kept": F.lit("x"), "_id": F.lit(2)})
    found = sorted(sd.suffix_dedup(docs.repartition(5), group=group).collect())
    assert [tuple(r)[1:] for r in found] == [(a, b, c, bytearray(k)) for a, b, c, k in plain(texts)]


def test_texts_without_repeats_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = prose(300)
    texts = [prose(400) for _ in range(2_000)] + [prose(50) + shared + prose(k) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    told, frames = sd.with_maybe, []
    monkeypatch.setattr(sd, "with_maybe", lambda *given: frames.append(told(*given)) or frames[-1])
    found = {r[0]: r[2] for r in sd.suffix_dedup(docs).collect()}
    assert {i for i, n in found.items() if n} == {2_000, 2_001, 2_002} and len(found) == len(texts)
    assert len(frames) == 2  # where the ends of repeats are sorted, and where texts are cut
    for frame in frames:
        asked = {r[0]: r[1] for r in frame.select("_id", "_maybe").collect()}
        assert len(asked) == len(texts) and all(asked[i] for i in (2_000, 2_001, 2_002))
        assert sum(asked.values()) < 100


def test_bitmaps_miss_no_key(spark, monkeypatch):
    key = F.when(F.col("id") > 10, F.col("id")).alias("a")
    keys = spark.range(0, 20_000, 2).select(key, F.lit(3).alias("b"))
    rows = spark.range(20_000).select(key, F.lit(3).alias("b"), "id")
    for pages in (1, 2, common.MAX_PAGES):
        monkeypatch.setattr(common, "MAX_PAGES", pages)
        marked = common.with_maybe(rows, common.key_bitmaps(keys, common.Scratch(spark, "bitmaps")), "a", "b")
        found = {r[0]: r[1] for r in marked.select("id", "_maybe").collect()}
        assert len(found) == 20_000 and all(found[i] for i in range(0, 20_000, 2))
        wrong = sum(found[i] for i in range(11, 20_000, 2))
        assert wrong < (1_000 if pages > 2 else 4_000)
        assert "hashpartitioning" not in marked._jdf.queryExecution().toString()


def test_repeated_rows_and_missing_ids(spark):
    rng = random.Random(9)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, one), (1, one), (2, two), (2, two + "!"), (None, one[:250]), (None, None), (3, two[100:320] + one[:199])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (str(r[0]), r[1:])
    found = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in sd.suffix_dedup(docs).collect()), key=key)
    assert found == sorted(((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]))), key=key)
    assert sd.suffix_dedup(docs.limit(0), carry=("text",)).count() == 0
    assert sd.suffix_dedup(docs.where("doc_id = 3")).collect()[0]["n_removed"] == 0


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 8])
def test_merge_is_a_sort_with_common_prefixes(runs):
    rng = random.Random(runs)
    items = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))), b"x" * rng.randrange(3), rng.randrange(-5, 5), i, i % 2) for i in range(300)]
    items += items[:20]
    dealt = [sorted(items[i::runs], key=lambda x: (x[0], x[2], x[3])) for i in range(runs)]
    packed = [sd.encode_run(d) for d in dealt]
    assert [[x for _, x in sd.decode_run(p)] for p in packed] == dealt
    merged = list(sd.merge_runs([sd.decode_run(p) for p in packed]))
    assert [x for _, x in merged] == sorted(items, key=lambda x: (x[0], x[2], x[3]))
    last = b""
    for prefix, item in merged:
        assert prefix == sd._common(last, item[0], 0)
        last = item[0]


def test_merge_compares_no_known_prefix(monkeypatch):
    """Every comparison of bytes begins where both are known to share as much."""
    starts = []
    plain_common = sd._common
    monkeypatch.setattr(sd, "_common", lambda a, b, start: starts.append((a[:start] == b[:start], start)) or plain_common(a, b, start))
    items = sorted((b"p" * 50 + bytes([97 + i % 26]) * (i % 7), b"", i, i, 1) for i in range(200))
    packed = [sd.encode_run(items[i::4]) for i in range(4)]
    starts.clear()
    assert len(list(sd.merge_runs([sd.decode_run(p) for p in packed]))) == 200
    assert all(same for same, _ in starts) and sum(start >= 50 for _, start in starts) >= len(starts) - 3


def test_whole_documents(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in sd.suffix_dedup(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert found == {i: p for (i, _), p in zip(rows, plain([t for _, t in rows]))}
    assert any(p[1] for p in found.values())
