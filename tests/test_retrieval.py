import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.blocked_topk import Limits
from ledgerlens.operators.fusion import concat_retrieval, reciprocal_rank_fusion
from ledgerlens.operators.hybrid import depth_for, hybrid_topk
from ledgerlens.operators.lexical_search import bm25_topk
from ledgerlens.operators.vector_search import vector_topk
from ledgerlens.sources.tables import table

# Queries in several broadcast parts.
PARTS = Limits(broadcast_bytes=60_000, queries_per_block=7, cells_per_step=800)
# One part with several query blocks.
STEPS = Limits(queries_per_block=9, cells_per_step=50)


def listed(df, query="query_id", doc="doc_id"):
    return sorted((r[query], r["rank"], r[doc], r["score"]) for r in df.collect())


@pytest.mark.parametrize("limits", [Limits(), STEPS, PARTS])
def test_vectors_against_numpy(spark, data, limits):
    vectors = table(spark, data, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    rows = vectors.collect()
    ids = np.array([r.doc_id for r in rows])
    m = np.array([r.embedding for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(m @ m.T, 6)
    expected = []
    for q in range(len(ids)):
        order = np.lexsort((ids, -scores[q]))[:4]
        expected += [(ids[q], n + 1, ids[i], scores[q][i]) for n, i in enumerate(order)]
    got = listed(vector_topk(queries, vectors, 4, limits=limits))
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected)]
    assert np.allclose([g[3] for g in got], [e[3] for e in sorted(expected)], atol=2e-6)


@pytest.mark.parametrize("limits", [Limits(), STEPS, PARTS])
def test_every_vector_is_its_own_nearest(spark, data, limits):
    vectors = table(spark, data, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    out = vector_topk(vectors.withColumnRenamed("doc_id", "query_id"), vectors, 1, limits=limits)
    assert out.where("query_id <> doc_id OR score <> 1.0").count() == 0


@pytest.mark.parametrize("limits", [Limits(), STEPS, PARTS])
def test_copies_go_by_key_and_unusable_vectors_are_left_out(spark, limits):
    copies = [(i, [1.0, 0.0]) for i in range(400)]
    others = [(1000 + i, [10.0, float(i)]) for i in range(1, 200)]
    unusable = [(5000, [0.0, 0.0]), (5001, None)]
    corpus = spark.createDataFrame(copies + others + unusable, "doc_id long, embedding array<float>")
    queries = spark.createDataFrame(
        [(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "query_id long, embedding array<float>"
    )
    got = listed(vector_topk(queries.repartition(3), corpus.repartition(5), 3, limits=limits))
    assert [(q, d) for q, _, d, _ in got] == [(1, 0), (1, 1), (1, 2), (2, 1199), (2, 1198), (2, 1197)]


@pytest.mark.parametrize("limits", [Limits(), STEPS, PARTS])
def test_undefined_numbers_and_other_widths_cost_no_hit(spark, limits):
    good = [(i, [1.0, float(i)]) for i in range(1, 9)]
    odd = [(100 + i, [float("nan"), 1.0]) for i in range(7)] + [(200 + i, [None, 1.0]) for i in range(7)]
    odd += [(300, [float("inf"), 1.0]), (301, [-float("inf"), 0.0]), (302, [1.0]), (303, [1.0, 2.0, 3.0]), (304, [])]
    corpus = spark.createDataFrame(good + odd, "doc_id long, embedding array<double>").coalesce(1)
    asked = [(1, [0.0, 1.0]), (2, [1.0]), (3, [float("nan"), 0.0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = listed(vector_topk(queries, corpus, 5, limits=limits))
    assert [(q, d) for q, _, d, _ in got] == [(1, 8), (1, 7), (1, 6), (1, 5), (1, 4)]


def test_fusion_depth():
    for k in (1, 5, 100, 500):
        d = depth_for(k)
        assert round(2 / (61 + d), 6) < round(1 / (60 + k), 6) and d <= 2 * k + 60 + k
    assert depth_for(5) == 70


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_bytes=2000, queries_per_block=2, cells_per_step=97)])
def test_hybrid_ranks_full_lists(spark, limits):
    """Documents far down in both lists, ties everywhere, rows that only one list holds."""
    rng = np.random.default_rng(3)
    n = 400
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(n)]
    x = rng.integers(-2, 3, (n, 3)).astype(float)
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, n, 2)], "doc_id long, embedding array<double>")
    asked = [(q, " ".join(rng.choice(words, 2)), rng.integers(-2, 3, 3).astype(float).tolist()) for q in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, text string, embedding array<double>")
    found = [tuple(r) for r in hybrid_topk(queries, vectors, corpus, 5, limits=limits).orderBy("query_id", "rank").collect()]
    dense = vector_topk(queries, vectors, n).select("query_id", "doc_id", "rank")
    lexical = bm25_topk(queries, corpus, n).select("query_id", "doc_id", "rank")
    whole = reciprocal_rank_fusion([dense, lexical], 5).orderBy("query_id", "rank")
    assert found == [tuple(r) for r in whole.collect()]


@pytest.mark.parametrize("limits", [Limits(), STEPS, PARTS])
def test_bm25_against_brute_force(spark, limits):
    docs = {
        1: "the cat sat on the mat",
        2: "the dog",
        3: "Cat, cat and DOG!",
        4: "",
        5: "nothing here at all",
        6: "the the the the",
    }
    queries = {1: "cat the", 2: "dog dog", 3: "absent", 4: "", 5: "here"}
    words = {d: "".join(c.lower() if c.isalnum() else " " for c in t).split() for d, t in docs.items()}
    mean = sum(map(len, words.values())) / len(words)
    expected = []
    for q, text in queries.items():
        scored = []
        for d, w in words.items():
            s = 0.0
            for term in set(text.split()):
                df = sum(term in x for x in words.values())
                tf = w.count(term)
                if tf:
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s:
                scored.append((-round(s, 6), d))
        expected += [(q, n + 1, d) for n, (_, d) in enumerate(sorted(scored)[:2])]
    corpus = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = listed(bm25_topk(asked, corpus, 2, limits=limits))
    assert [g[:3] for g in got] == sorted(expected)


def test_bm25_in_parts_agrees_on_the_documents(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "benchmark")
    a = listed(bm25_topk(items, docs, query_key="item_id"), "item_id")
    b = listed(bm25_topk(items, docs, query_key="item_id", limits=PARTS), "item_id")
    assert a == b and len(a) == 200


def test_empty_inputs(spark):
    corpus = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert vector_topk(none, corpus).count() == 0
    assert vector_topk(corpus.withColumnRenamed("doc_id", "query_id"), corpus.where("false")).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert bm25_topk(asked, docs).count() == 0


def test_fusion_and_concatenation(spark):
    schema = "query_id long, doc_id long, rank long"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    got = listed(reciprocal_rank_fusion([a, b], 2))
    assert got == [(1, 1, 11, round(1 / 61 + 1 / 62, 6)), (1, 2, 10, round(1 / 61, 6))]
    both = concat_retrieval(a, b, "query_id", "doc_id")
    assert both.count() == 4  # document 11 stays twice


def test_tasks_send_fewer_than_k_rows_per_query(spark):
    """With many splits the k-th score of a few of them keeps most rows in their tasks."""
    from ledgerlens.operators.blocked_topk import topk_candidates
    from ledgerlens.operators.vector_search import cosine, prepared_vectors

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(6400)]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(64)
    queries = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(4)], "query_id long, embedding array<double>")
    q, c, _ = prepared_vectors(queries, corpus, "query_id", "doc_id", "embedding")
    sent = {n: topk_candidates(q.toArrow(), c, cosine, 10, Limits(floor_every=n)).count() for n in (4, 10_000)}
    assert sent[10_000] == 64 * 4 * 10 and sent[4] < sent[10_000] / 8
    assert listed(vector_topk(queries, corpus, 10, limits=Limits(floor_every=4))) == listed(vector_topk(queries, corpus, 10))


def test_hybrid_reads_texts_once_and_vectors_twice(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "rho"]
    texts, vectors = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(total):
        def run(batches):
            for b in batches:
                total.add(b.num_rows)
                yield b

        return run

    rows = [(i, " ".join(rng.choice(words, 6)), rng.normal(size=3).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>").repartition(3)
    corpus = df.select("doc_id", "text").mapInArrow(counted(texts), "doc_id long, text string")
    dense = df.select("doc_id", "embedding").mapInArrow(counted(vectors), "doc_id long, embedding array<double>")
    asked = [(q, " ".join(rng.choice(words, 2)), rng.normal(size=3).tolist()) for q in range(5)]
    queries = spark.createDataFrame(asked, "query_id long, text string, embedding array<double>")
    assert hybrid_topk(queries, dense, corpus, 5).count() == 25
    assert texts.value == 300 and vectors.value <= 600
