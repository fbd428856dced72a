"""What a top-k scan holds in a task, and that keeping less keeps the right rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.blocked_topk import Limits, _Best, _top_scan, rounded
from ledgerlens.operators.vector_search import cosine
from ledgerlens.session import tune

SCHEMA = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("score", pa.float64())])


def vectors(rng, n, width):
    return pa.table({"id": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(rng.normal(size=n * width), width).cast(pa.list_(pa.float64()))})


def test_a_scan_of_many_queries_holds_little():
    rng = np.random.default_rng(1)
    queries, corpus = vectors(rng, 4096, 8), vectors(rng, 6000, 8)
    tracemalloc.start()
    found = list(_top_scan(queries, iter([corpus]), cosine, 5, np.full(4096, -np.inf), SCHEMA, Limits()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(t.num_rows for t in found) == 5 * 4096
    assert peak < 64 << 20


@pytest.mark.parametrize("k, digits", [(1, 1), (3, 1), (3, 6), (40, 2), (500, 1)])
def test_the_best_are_those_of_a_sort(k, digits):
    """Ties, scores that differ beyond the sixth place, scores that are no match or no number."""
    rng = np.random.default_rng(k)
    scores = np.round(rng.normal(size=(400, 30)), digits) + rng.choice([0, 3e-7, -3e-7], size=(400, 30))
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[rng.random(scores.shape) < 0.05] = np.nan
    scores[:, 0] = 0.5
    scores[:, 1] = -np.inf
    ids = rng.permutation(400)
    best = _Best(k, np.full(30, -np.inf))
    best.room = 200
    for at in range(0, 400, 25):
        best.add(ids[at : at + 25], scores[at : at + 25])
    query, score, found = best.settle()
    whole = rounded(scores)
    for q in range(30):
        order = [i for i in np.lexsort((ids, -whole[:, q])) if whole[i, q] > -np.inf][:k]
        assert found[query == q].tolist() == ids[order].tolist()
        assert score[query == q].tolist() == whole[order, q].tolist()


def test_scores_below_known_floors_are_compared_only(monkeypatch):
    def partition(*_, **__):
        raise AssertionError("scores were partitioned")

    best = _Best(3, np.full(50, 10.0))
    monkeypatch.setattr(np, "partition", partition)
    scores = np.zeros((100, 50))
    scores[7, 4] = 11
    best.add(np.arange(100), scores)
    assert [x.tolist() for x in best.settle()] == [[4], [11.0], [7]]


def test_long_texts_come_to_workers_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    rows = tune(spark).range(0, 4000, 1, 1).select(F.split(F.repeat(F.lit("word "), 1000), " ").alias("t"))
    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 12 << 20
