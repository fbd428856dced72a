"""Nearest neighbours: recall against brute force, exact scores, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import ann
from ledgerlens.llm.ann import Settings, nearest


def exact(ids, x, query, k):
    d = np.sqrt(((x - x[ids == query][0]) ** 2).sum(axis=1))
    other = ids != query
    order = np.lexsort((ids[other], d[other]))[:k]
    return list(zip(ids[other][order].tolist(), d[other][order].tolist()))


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores_over_whole_table(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    near = found(nearest(vectors, lambda i: i % 5 == 0, settings=Settings(rows_per_list=16, beam=8)).collect())
    assert set(near) == set(ids[ids % 5 == 0].tolist())
    hits = 0
    for q, some in near.items():
        d = dict(exact(ids, x, q, len(ids)))
        assert all(abs(d[i] - score) < 1e-12 for i, score in some) and len(some) == 10
        hits += len({i for i, _ in some} & {i for i, _ in exact(ids, x, q, 10)})
    assert hits / len(near) / 10 >= 0.9


def test_graph_walk_finds_near_centroids():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3000, 16)).astype(np.float32)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    ids, d = ann.CentroidGraph.build(centre, 24).search(x, 8, 64)
    truth = np.argsort(ann._distances(x, centre), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids.tolist(), truth.tolist())]) > 0.9
    assert all(len(set(a)) == 8 for a in ids.tolist()) and (np.diff(d, axis=1) >= 0).all()


def test_odd_vectors_hot_vector_and_ties(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    hot = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 160)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]),
           (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0]), (206, []), (None, [1.0, 0.0, 0.0, 0.0]), (0, good[0][1])]
    vectors = spark.createDataFrame(good + hot + odd, "vec_id long, embedding array<double>").withColumns(
        {"_v": F.lit("x"), "rank": F.lit(1), "query_id": F.lit(1)})
    settings = Settings(rows_per_list=8, rows_per_block=16, queries_per_block=8)
    near = found(nearest(vectors, lambda i: i % 50 == 0, 10, settings).collect())
    ids, x = np.array([r[0] for r in good + hot]), np.array([r[1] for r in good + hot])
    assert set(near) == {0, 50, 100, 150}
    assert near[100] == exact(ids, x, 100, 10) == [(i, 0.0) for i in range(101, 111)]
    assert near[150] == [(i, 0.0) for i in range(100, 110)]


def test_few_candidates_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = found(nearest(vectors, lambda i: i == 3, settings=Settings(rows_per_list=1)).collect())
    assert [i for i, _ in near[3]] == [1, 2]
    assert nearest(vectors.where("vec_id = 1"), lambda i: i == 1).count() == 0
    assert nearest(vectors.limit(0), lambda i: i == 1).count() == 0


def test_walks_go_on_while_the_last_list_is_inside_the_ratio(spark, data, monkeypatch):
    from dataclasses import replace

    vectors, settings = spark.read.parquet(f"{data}/embeddings.parquet"), Settings(rows_per_list=16, beam=8)
    whole = found(nearest(vectors, lambda i: i % 20 == 0, settings=settings).collect())
    fit = ann.Reach.fit
    monkeypatch.setattr(ann.Reach, "fit", staticmethod(lambda *a: replace(fit(*a), lists=1)))
    again = found(nearest(vectors, lambda i: i % 20 == 0, settings=settings).collect())
    hits = sum(len(set(again[q]) & set(whole[q])) for q in whole)
    assert hits >= 0.98 * sum(map(len, whole.values()))


def test_the_sample_is_settled_where_rows_are_read(spark):
    from ledgerlens.llm.common import below

    rows = spark.range(20_000).repartition(4)
    some = below(rows, 0.1, "id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert 1700 < some.count() < 2300 and "TakeOrdered" not in plan and "Limit" not in plan
    assert below(rows, 1.0, "id").count() == 20_000 and below(rows, 7, "id").count() == 20_000
