"""Packing: token ids by the plain tokenizer, windows by a plain differencing, nothing lost."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm.packing import ChunkTokens, difference_partition, pack_documents, pack_group
from ledgerlens.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n ", "Hello WORLD, it's 3.14 o'clock!!", "<|endoftext|> a<|STARTOFTEXT|>b <|startoftext|>", "É é é ÀÉ ΑΣ Σ ΑΣ. ǅ",
    "a b\x1cc d\x85e", "zero​width ﻿ bom", "漢字 かな 😀😀", " ́ x", "I'LL we'Re 'S", "x" * 3000, "word " * 5000,
]


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("most", [4, 30, 10**6])
def test_ids_are_the_tokenizers(most):
    tokens = ChunkTokens(PATH, most)
    for _ in range(3):
        for text, ids in zip(TEXTS, plain(TEXTS)):
            assert tokens.encode([text])[0].tolist() == ids
    assert [x.tolist() for x in tokens.encode(TEXTS)] == plain(TEXTS)


def test_letters_that_only_compose_small():
    texts = [f"one {a}{b} Two{a}{b}x" for a, b in ("J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a")] + ["E\u0301 \u0130 Z"]
    tokens = ChunkTokens(PATH)
    assert [x.tolist() for x in tokens.encode(texts)] == plain(texts)
    assert [tokens.encode([t])[0].tolist() for t in texts] == plain(texts)


def test_plain_words_need_no_normaliser_or_splitter(monkeypatch):
    rng = random.Random(7)
    letters = "abcstvreldmXYZ\u00df\u00e9\u00f1\u00fc\u00c9\u00ff'\"''0189.,!-_$<|>^~`@[ \t\n"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(4_000)]
    texts = [" ".join(words[i : i + 100]).replace("<|", "<") for i in range(0, len(words), 100)]
    tokens, asked = ChunkTokens(PATH), []
    whole = tokens._alone
    monkeypatch.setattr(tokens, "_alone", lambda some: asked.extend(some) or whole(some))
    assert [x.tolist() for x in tokens.encode(texts)] == plain(texts)
    assert not asked
    odd = [t + " \u6f22 a\u00d7b\u00f7\u00e9 x\x1cy \u0391\u03a3 e\u0301 \u00aa\u00b5 \u2019s<|endoftext|> \U0001f600." for t in texts]
    assert [x.tolist() for x in tokens.encode(odd)] == plain(odd)
    assert asked


def slow_differencing(sizes, n):
    """The textbook form, with whole vectors; gives the sums."""
    parts = [(size, i, [size] + [0] * (n - 1)) for i, size in enumerate(sizes)]
    tie = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        a, b = parts.pop(0), parts.pop(0)
        merged = sorted((x + y for x, y in zip(a[2], reversed(b[2]))), reverse=True)
        merged = [x - merged[-1] for x in merged]
        parts.append((merged[0], tie, merged))
        tie += 1
    return parts[0][0]


@pytest.mark.parametrize("seed", range(6))
def test_differencing(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 300) for _ in range(rng.randrange(1, 60))]
    for n in (1, 2, 3, 7, 80):
        windows = difference_partition(sizes, n)
        assert len(windows) == n and sorted(i for w in windows for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert n == 1 or max(sums) - min(sums) == slow_differencing(sizes, n)


def test_window_count_rises_until_all_fit():
    assert len(pack_group([1500, 1500, 1000], 2048)) == 3
    assert pack_group([], 2048) == []
    windows = pack_group([700] * 6, 2048)
    assert all(len(w) <= 2 for w in windows) and len(windows) == 3


def check(rows, texts, capacity=2048):
    ids = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        own = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(own) == r["length"] > 0
        ids[r["doc_id"]].append((r["start"], own, r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    for (doc, text), own in zip(texts, plain([t for _, t in texts])):
        found = sorted(ids.pop(doc))
        assert [i for _, part, _ in found for i in part] == own + [1]
        assert all(total == len(own) + 1 for *_, total in found)
        assert [start for start, *_ in found] == [sum(len(p) for _, p, _ in found[:n]) for n in range(len(found))]
    assert not ids
    return sum(r["length"] for r in rows) / capacity / max(1, len(places))


def test_odd_rows(spark):
    texts = list(enumerate(TEXTS))
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"ids": F.lit(1), "offset": F.lit("x")})
    check(pack_documents(docs, PATH).collect(), texts)
    check(pack_documents(docs, PATH, capacity=64, max_piece=100, windows_per_group=3).collect(), texts, 64)
    assert pack_documents(docs.limit(0), PATH).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(r["length"] for r in pack_documents(same, PATH).collect()) == [3] * 4


def test_whole_documents_with_little_padding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check(pack_documents(docs.coalesce(1), PATH).collect(), texts) > 0.97
