"""SimHash components against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace(
        "\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(prints, max_bits):
    """{id: smallest id reachable} by comparing all pairs."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(
    "text", [None, "", " \n ", "One", "a B c", "a b c d", "A b c d e a b c d", "é É x\x0by z w v", "w " * 5000]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def planted(n_random=150, seed=5):
    rng = random.Random(seed)
    prints = {}
    for i in range(n_random):
        prints[i] = rng.getrandbits(64)
    chain = rng.getrandbits(64)
    for i in range(n_random, n_random + 40):  # a chain: each four bits from the one before
        for bit in rng.sample(range(64), 4):
            chain ^= 1 << bit
        prints[i] = chain
    base = rng.getrandbits(64)
    for i in range(n_random + 40, n_random + 140):  # a dense cluster, one hot list
        prints[i] = base ^ sum(1 << bit for bit in rng.sample(range(12), rng.randrange(6)))
    prints[n_random + 140] = prints[3]
    prints[n_random + 141] = 0
    prints[n_random + 142] = 0b1111
    prints[n_random + 143] = 0b11111 << 10
    return prints


@pytest.mark.parametrize("block", [simhash.BLOCK, 16])
def test_components_match_all_pairs(spark, monkeypatch, block):
    prints = planted()
    rows = [(i, np.uint64(p).astype(np.int64).item()) for i, p in prints.items()]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select("doc_id", "fp"))
    docs = spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    found = {r[0]: r[2] for r in simhash.simhash_components(docs, block=block).collect()}
    assert found == slow_components(prints, 4)


def test_odd_rows(spark):
    rows = [(7, None), (4, ""), (4, ""), (None, " "), (9, "one two three four five"), (2, "ONE two\tthree four five")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "_list": F.lit(1)})
    found = sorted(((r[0], r[2]) for r in simhash.simhash_components(docs).collect()), key=str)
    assert found == [(2, 2), (4, 4), (4, 4), (7, 4), (9, 2), (None, 4)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.simhash_components(docs.where("doc_id is null")).collect()[0]["component_id"] is None


def test_whole_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    found = {r[0]: (r[1] % 2**64, r[2]) for r in simhash.simhash_components(docs).collect()}
    roots = slow_components(prints, 4)
    assert found == {i: (prints[i], roots[i]) for i in prints}
