import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import alignment, queries
from ledgerlens.llm.alignment import BLOCK, DENSE, Aligned, align_tokenizers, pack_places, unpack_places

A = queries.tokenizer_path("byte_bpe_50k.json")
B = queries.tokenizer_path("piece_bpe_32k.model")


def slow(texts):
    """Whole texts, byte offsets in dictionaries, counts of all links."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment._byte_letters()
    spell = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if all(c in letters for c in t)}
    found = []
    for text in texts:
        full = " " + (text or "")
        ids_a = a.encode(full, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [spell[i] for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != full.encode() or b"".join(bytes_b) != full.encode():
            found.append(None)
            continue
        ends_a = dict(zip(np.cumsum([len(x) for x in bytes_a]).tolist(), range(len(ids_a))))
        ends_b = dict(zip(np.cumsum([len(x) for x in bytes_b]).tolist(), range(len(ids_b))))
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for end in common:
            groups.append((ids_a[i : ends_a[end] + 1], ids_b[j : ends_b[end] + 1]))
            i, j = ends_a[end] + 1, ends_b[end] + 1
        found.append((ids_a, ids_b, groups))
    links = Counter((g[0][-1], g[1][-1]) for f in found if f for g in f[2])
    docs = Counter(p for f in found if f for p in {(g[0][-1], g[1][-1]) for g in f[2]})
    highest = Counter()
    for (_, y), n in links.items():
        highest[y] = max(highest[y], n)
    rows = []
    for f in found:
        if not f:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        pairs = [(g[0][-1], g[1][-1]) for g in f[2]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        rows.append(
            (len(f[0]), len(f[1]), len(f[2]), len(pairs), sum(links[p] == highest[p[1]] for p in pairs),
             sum(links[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest())
        )
    return rows, {(*p, docs[p], n, n == highest[p[1]]) for p, n in links.items()}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def run(spark, rows, **more):
    done = align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, **more)
    got = sorted((r["doc_id"] is None, r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in done.documents.collect())
    return got, {tuple(r) for r in done.pairs.select("a", "b", "docs", "links", "best").collect()}


def expected(rows):
    found, pairs = slow([t for _, t in rows])
    return sorted((i is None, i, f) for (i, _), f in zip(rows, found)), pairs


HARD = [
    "a;\r\nb", "a ;\r b\r", "x\r", "\r\n\r\n", " ", "   ", "\n", "\nab", "a ", "a \n\n b  ", "a▁b", "▁", "  y", "x \n y　z",
    "<|endoftext|> <s> </s><unk>", "don't we'll I'M", "12345 6.7e8", "漢字 ไทย \U0001f600‍", "é̈", "\x00 \x1c\x1f a\x85b", "tab\t\tx \t y",
    "a" * 300, " " * 300 + "z", "()();\r{\r}\r", "﻿bom", "   x",
]


def test_hard_texts_against_the_plain_version(spark):
    rng = random.Random(2)
    pool = ["a", " ", "\n", "\r", ";", "the", " ", "é", "漢", "1", "\t", ")", "▁x", "\x1c"]
    texts = HARD + ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(300)]
    rows = list(enumerate(texts))
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("flush, block", [(50, 7), (1, 65536), (10**6, 3)])
def test_partial_bitmaps_and_small_blocks(spark, flush, block):
    rng = random.Random(3)
    words = ["the", "thing", "Haus", "einbüßen", "x1", "to", ",", "\n"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 90)))) for i in range(60)]
    assert run(spark, rows, flush=flush, docs_per_block=block) == expected(rows)


def test_query_against_the_plain_version(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op12_alignment(spark, data).collect()
    assert sorted((False, r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in got) == expected(rows)[0]


def test_nulls_repeats_other_columns_and_an_empty_table(spark):
    rows = [(1, None), (2, ""), (None, "the thing"), (3, "the thing"), (3, "the thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_block", F.lit("x")).withColumn("n_a", F.lit(0.5))
    done = align_tokenizers(docs, A, B)
    assert sorted((r["doc_id"] is None, r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in done.documents.collect()) == expected(rows)[0]
    assert run(spark, []) == ([], set())


def test_very_long_texts(spark):
    rows = [(1, "the quick thing\n" * 100_000), (2, "zü" * 200_000), (3, "the quick thing"), (4, "the ▁" * 90_000)]
    got, pairs = run(spark, rows)
    want = expected([(1, "the quick thing\n" * 100_000), (2, "zü" * 200_000), (3, "the quick thing"), (4, None)])
    assert got == want[0] and pairs == want[1]


def test_what_is_remembered_is_bounded():
    aligned = Aligned(A, B, most=50)
    for i in range(20):
        aligned.learn({f" w{i}x{j}" for j in range(20)})
        assert len(aligned.known) <= 50 and len(aligned.spelt) == len(aligned.sizes) == len(aligned.known)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(0)
    runs = [np.sort(rng.choice(BLOCK, n, replace=False)) for n in (1, 5, DENSE - 1, DENSE, DENSE + 1, BLOCK, 3)]
    starts = np.cumsum([0, *map(len, runs[:-1])])
    for some in (runs, runs[:3]):
        places, counts = unpack_places(pack_places(np.concatenate(some), starts[: len(some)]))
        assert counts.tolist() == list(map(len, some)) and (places == np.concatenate(some)).all()
    assert unpack_places(pa.array([], pa.binary()))[0].tolist() == []
