"""N-best segmentation against all segmentations; decoding as a round trip and against the library."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerlens.llm import queries
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.llm.segmentation import _CHUNK, ChunkSegments, PieceTable, _n_best_by_node, best_and_loss, decode_pieces, n_best, n_best_pieces

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  Hello   world\n\tx é 漢 😀 ", "the,  and. the!", "a\n\n b", "naïve café №5 ²x", "▁x ▁", "word " * 3, "x" * 400, "1,234.5 http://a.b/c?d=e#f",
    "\x00\x1f\x7f﻿", " lead", "trail  ",
]


@pytest.fixture(scope="module")
def pieces():
    return PieceTable(PATH)


def all_paths(text, table):
    """Every segmentation of a text as (score, ids, chunk by chunk choices unknown)."""
    if not text:
        return [(0.0, ())]
    out = []
    for j in range(1, min(len(text), table.longest) + 1):
        arc = table.arcs.get(text[:j])
        if arc:
            out += [(s + arc[1], (arc[0], *ids)) for s, ids in all_paths(text[j:], table)]
    if text[0] not in table.arcs:
        spelt = tuple(table.byte_ids[b] for b in text[0].encode())
        out += [(s + table.unknown, spelt + ids) for s, ids in all_paths(text[1:], table)]
    return out


@pytest.mark.parametrize("chunk", [" the", "aaaa", " ing", ".com", "漢a", "   x", "\n", "été", "abab", " "])
def test_chunk_matches_all_segmentations(pieces, chunk):
    every = sorted(all_paths(chunk, pieces), key=lambda p: (-p[0], p[1][::-1]))
    for n in (1, 2, 5, 1000):
        assert n_best(chunk, pieces, n) == every[:n]
    best, loss = best_and_loss(chunk, pieces)
    assert best == every[0] and loss == (every[0][0] - every[1][0] if len(every) > 1 else float("inf"))


@pytest.mark.parametrize("mark", "x-.#")
@pytest.mark.parametrize("size", [255, 256, 300])
def test_one_tie_rule_at_every_length(pieces, mark, size):
    chunk = " " + mark * size
    found = n_best(chunk, pieces, 4)
    assert found[0] == best_and_loss(chunk, pieces)[0]
    assert found == sorted(found, key=lambda p: (-p[0], p[1][::-1])) and len({ids for _, ids in found}) == 4
    (texts,) = ChunkSegments(pieces, 4).segment([mark * size])
    assert len({tuple(ids.tolist()) for _, ids, _ in texts}) == 4


@pytest.mark.parametrize("chunk", [" " + "x" * 40, "-" * 33, " the" + "a" * 30, "漢" * 20 + ".." * 9, "   " * 9])
def test_both_ways_to_the_best(pieces, chunk):
    for n in (1, 2, 4, 30):
        assert _n_best_by_node(chunk, pieces, n) == n_best(chunk, pieces, n)


def slow_text(text, table, n):
    """All choices of all chunks, each chunk's in its own order."""
    combined = [(0.0, (), ())]
    for chunk in _CHUNK.findall(" " + text):
        own = sorted(all_paths(chunk, table), key=lambda p: (-p[0], p[1][::-1]))
        combined = [(s + t, (c, *cs), ids + more) for s, cs, ids in combined for c, (t, more) in enumerate(own)]
        # Only what may be among the n best in the end goes on; choices are read from the last chunk.
        combined = sorted(combined, key=lambda p: (-p[0], p[1]))[: 4 * n]
    return [(s, ids) for s, _, ids in combined[:n]]


@pytest.mark.parametrize("n", [1, 2, 4, 7])
def test_text_matches_all_segmentations(pieces, n):
    segments = ChunkSegments(pieces, n)
    for text in ("it it it", "a b", "the and", "ab, ab", "x\nx y", "in on\nin"):
        (found,) = segments.segment([text])
        assert [(s, tuple(i.tolist())) for s, i, _ in found] == slow_text(text, pieces, n)


def test_text_is_one_lattice(pieces):
    """Cutting at chunks loses no segmentation."""
    for text in ("a, b", "it is", "o\no"):
        every = sorted(-s for s, _ in all_paths(" " + text, pieces))[:6]
        assert [-s for found in ChunkSegments(pieces, 6).segment([text]) for s, _, _ in found] == every


def test_forgetting_changes_nothing(pieces):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de,\n") for _ in range(60)) for _ in range(40)]
    wide, narrow = ChunkSegments(pieces, 3), ChunkSegments(pieces, 3, most=8)
    for some in (texts[:7], texts[7:9], texts, texts[::-1]):
        for a, b in zip(wide.segment(some), narrow.segment(some), strict=True):
            assert [(s, i.tolist(), t) for s, i, t in a] == [(s, i.tolist(), t) for s, i, t in b]


def test_round_trip_and_odd_rows(spark):
    rows = [*enumerate(TEXTS), (100, None), (None, "a b"), (1, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "rank": F.lit("x")})
    out = decode_pieces(n_best_pieces(docs, PATH, 3), PATH).collect()
    at_once = n_best_pieces(docs, PATH, 3, decoded=True).collect()
    assert sorted(map(str, out)) == sorted(map(str, at_once))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    expected = dict(rows)
    for r in out:
        text = (expected[r["doc_id"]] or "").replace("▁", " ")
        assert r["text"] == text
        assert " " + text == " " + library.decode(np.frombuffer(r["ids"], "<u4").tolist()) or not text.strip() or text[0] == " "
    # A single space has two segmentations, and its row comes twice.
    assert sorted(r["rank"] for r in out if r["doc_id"] == 1) == [1, 1, 2, 2]
    assert [r["text"] for r in out if r["doc_id"] is None and r["rank"] == 1] == ["a b"]
    assert [r["ids"] for r in out if r["doc_id"] == 100] == [b""]
    assert n_best_pieces(docs.limit(0), PATH).count() == 0


def test_whole_documents(spark, data):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    out = queries.op8_segmentation(spark, data).collect()
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in out)
    ranks = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["rank"])):
        assert r["rank"] == len(ranks.setdefault(r["doc_id"], [])) + 1
        assert not ranks[r["doc_id"]] or r["score"] <= ranks[r["doc_id"]][-1]
        ranks[r["doc_id"]].append(r["score"])
    assert set(ranks) == set(texts)
