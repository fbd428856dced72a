"""The stored index against a scan of the texts, and what it does not read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import inverted_index
from ledgerlens.operators.blocked_topk import Limits
from ledgerlens.operators.inverted_index import Index, index_topk, open_index, write_segment
from ledgerlens.operators.lexical_search import bm25_topk
from ledgerlens.session import new_path

DOCS = "doc_id long, text string"


def rows(df, query="query_id"):
    return [tuple(r) for r in df.select(query, "rank", "doc_id", "score").orderBy(query, "rank").collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common, rare = ["the", "of", "and", "bank"], [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(1, 12)) + rng.choices(rare, k=rng.randrange(0, 3))) for _ in range(300)]
    found = list(enumerate(texts, 1000)) + [(1, ""), (2, None), (-3, "the bank"), (5000, "the The THE bank w7")]
    return spark.createDataFrame(found, DOCS).repartition(4).cache()


@pytest.fixture(scope="module")
def queries(spark):
    asked = [(1, "the bank of w7"), (2, "w3 w4"), (3, "absent"), (4, ""), (5, None), (6, "the the The"), (7, "w9 and absent"), (8, "and of bank the w1 w2")]
    return spark.createDataFrame(asked, "query_id long, text string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    path = new_path(spark, "index")
    write_segment(corpus.where("doc_id % 3 = 0"), path, 0, docs_per_block=8, buckets=4)
    write_segment(corpus.where("doc_id % 3 <> 0"), path, 1, docs_per_block=16, buckets=4)
    return open_index(spark, path, 4)


@pytest.mark.parametrize("k, k1, b", [(1, 1.2, 0.75), (5, 1.2, 0.75), (400, 1.2, 0.75), (5, 2.0, 0.0), (3, 0.5, 1.0)])
def test_same_as_a_scan(corpus, queries, index, k, k1, b):
    expected = rows(bm25_topk(queries, corpus, k, k1=k1, b=b))
    assert expected and rows(index_topk(queries, index, k, k1=k1, b=b)) == expected


def test_small_broadcasts_and_many_query_parts(corpus, queries, index, monkeypatch):
    monkeypatch.setattr(inverted_index, "QUERIES_PER_TASK", 2)
    assert rows(index_topk(queries, index, 4, limits=Limits(broadcast_bytes=10))) == rows(bm25_topk(queries, corpus, 4))


def test_only_buckets_of_query_terms_are_read(spark, queries, index):
    term = queries.where("query_id = 2")
    search = inverted_index._Search(index, inverted_index.query_terms(term, "query_id", "text")[0].select("query_id", F.explode("_terms").alias("term")), "query_id", 2, 1.2, 0.75, Limits())
    assert 0 < len(search.wanted_buckets) <= 2
    plan = search._pruned(index.postings)._jdf.queryExecution().executedPlan().toString()
    listed = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "bucket" in listed and all(str(b) in listed for b in search.wanted_buckets)


def test_blocks_that_cannot_win_are_left_out(spark, monkeypatch):
    """A rare term decides; blocks without it stay closed."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 7, "common needle").otherwise("common hay").alias("text"))
    path = new_path(spark, "index")
    write_segment(docs, path, docs_per_block=20)
    index, opened = open_index(spark, path), []
    score = inverted_index._Search.score
    monkeypatch.setattr(inverted_index._Search, "score", lambda self, blocks, floors: opened.append(blocks.count()) or score(self, blocks, floors))
    asked = spark.createDataFrame([(1, "common needle")], "query_id long, text string")
    found = rows(index_topk(asked, index, 4))
    assert [r[2] for r in found] == [7, 507, 1007, 1507]
    assert sum(opened) <= 8 and index.impacts.select("block").distinct().count() >= 90


def test_impacts_bound_every_posting(spark, index):
    joined = index.postings.select("segment", "term", "block", F.explode(F.arrays_zip("tfs", "lengths")).alias("p")).join(
        index.impacts, ["segment", "term", "block"]
    )
    covered = F.exists("impacts", lambda x: (x["tf"] >= F.col("p.tfs")) & (x["length"] <= F.col("p.lengths")))
    assert joined.where(~covered).count() == 0
    assert index.impacts.agg(F.sum("df")).first()[0] == joined.count()


def test_a_segment_written_again_replaces_itself_only(spark, corpus, queries):
    path = new_path(spark, "index")
    write_segment(corpus.where("doc_id % 2 = 0"), path, 0)
    write_segment(corpus, path, 1)
    write_segment(corpus.where("doc_id % 2 <> 0"), path, 1)
    assert rows(index_topk(queries, open_index(spark, path), 5)) == rows(bm25_topk(queries, corpus, 5))


def test_empty_index_and_no_queries(spark, queries, index):
    path = new_path(spark, "index")
    write_segment(spark.createDataFrame([], DOCS), path)
    empty = open_index(spark, path)
    assert isinstance(empty, Index) and empty.n_docs == 0 and index_topk(queries, empty).count() == 0
    assert index_topk(queries.where("false"), index).count() == 0


def test_names_of_keys(spark, index, queries, corpus):
    asked = queries.withColumnsRenamed({"query_id": "item", "text": "said"})
    got = index_topk(asked, index, 2, "item", "page", "said")
    assert got.columns == ["item", "page", "score", "rank"] and got.count() == bm25_topk(queries, corpus, 2).count()
