import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries
from ledgerlens.llm.spelling import near_words, pivots, spelling_variants, word_counts


def slow_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def slow_variants(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def dense_words(seed=1, n=700, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randrange(4, 9))): rng.choice([1, 1, 2, 3, 5, 8, 20, 100]) for _ in range(n)}
    return words | {"aaaaaaaa": 50, "aaaaaaa": 25, "aaaaaa": 12, "aaaaa": 6, "aaaa": 3}


@pytest.mark.parametrize("block", [8192, 5])
def test_dense_words_against_all_pairs(spark, block):
    words = dense_words()
    got = spelling_variants(frame(spark, words), least_chars=4, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(slow_variants(words), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_each_near_pair_comes_once(spark, seed):
    words = dense_words(seed, 300, "xyzüß漢字")
    got = [(r["word"], r["other"]) for r in near_words(frame(spark, words), least_chars=4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_query_against_the_plain_version(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    words = slow_words(rows)
    got = {tuple(r) for r in queries.op13_spelling(spark, data).collect()}
    assert {(r[0], r[3]) for r in got} == set(words.items())
    by_skeleton = {}
    for w in words:
        for s in {(w[:i] + w[i + 1 :], i) for i in range(len(w))}:
            by_skeleton.setdefault(s, set()).add(w)
    near = {w: set() for w in words}
    for (s, _), same in by_skeleton.items():
        for w in same:
            near[w] |= same - {w}
            if s in words:
                near[w].add(s)
                near[s].add(w)
    for word, form, root, n, n_near, form_n in got:
        best = min(near[word], key=lambda o: (-words[o], o), default=None)
        assert n_near == len(near[word])
        assert (form, form_n) == ((best, words[best]) if best and words[best] >= 2 * n else (None, None))
        assert (root == word) == (form is None)
    assert any(r[1] for r in got) and len({r[0] for r in got}) == len(got)


def test_ties_and_long_chains(spark):
    words = {"tested": 4, "bested": 9, "rested": 9, "vested": 8, "alone": 3}
    got = {r["word"]: (r["form"], r["form_n"]) for r in spelling_variants(frame(spark, words)).collect()}
    assert got["tested"] == ("bested", 9) and got["vested"] == (None, None) and got["alone"] == (None, None)
    chain = {"a" * (30 - i): 2**i for i in range(20)}
    assert {r["root"] for r in spelling_variants(frame(spark, chain)).collect()} == {"a" * 11}


def test_counts_of_words(spark):
    rows = [(i, "Straße ÄRGER× straße x÷yyyyy") for i in range(40)] + [(None, "straße Straße"), (7, None), (8, ""), (9, "ab " * 9)]
    rows += [(i, " ".join(f"word{'abcdefgh'[i % 8]}{'abcdefgh'[j % 8]}x" for j in range(64))) for i in range(100)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("word", F.lit("q")).withColumn("n", F.lit(1))
    assert {(r["word"], r["n"]) for r in word_counts(docs).collect()} == set(slow_words(rows + rows[:3]).items())


def test_a_very_long_text_and_a_very_long_word(spark):
    rows = [(1, "hither thither " * 100_000), (2, ("ab" * 30_000 + " ") * 3), (3, ("ab" * 30_000 + "c ") * 6)]
    words = word_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["word"]: r["form"] for r in spelling_variants(words).collect()}
    assert got["ab" * 30_000] == "ab" * 30_000 + "c" and set(got) == set(slow_words(rows))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(word_counts(docs)).collect() == []
    with pytest.raises(ValueError):
        near_words(word_counts(docs), least_chars=3)


def test_pivots_are_the_lightest_two_without_a_common_letter():
    rng = np.random.default_rng(0)
    for _ in range(300):
        places = np.sort(rng.choice(9, (1, 3), replace=False))
        weights = rng.integers(1, 9, (1, 3))
        a, b = pivots(places, weights)[0]
        cost = dict(zip(places[0], weights[0]))
        assert b - a >= 2
        assert cost[a] + cost[b] == min(cost[x] + cost[y] for x in cost for y in cost if y - x >= 2)
