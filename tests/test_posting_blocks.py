"""Posting lists are made where the texts are read."""

from pyspark.sql import functions as F

from ledgerlens.operators import inverted_index
from ledgerlens.operators.inverted_index import posting_blocks


def test_lists_are_made_without_a_shuffle_in_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(inverted_index, "WORDS_PER_BLOCK", 40)
    texts = [(i, " ".join(["a", "b", f"w{i % 7}"] * (1 + i % 4))) for i in range(200)] + [(900, "long " * 100), (901, ""), (902, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache()
    made = posting_blocks(docs, "doc_id", "text", 8)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    totals = made.where("term IS NULL").agg(F.sum("_docs"), F.sum("_words")).first()
    assert tuple(totals) == (202, sum(len((t or "").split()) for _, t in texts))
    lists = made.where("term IS NOT NULL").cache()
    assert lists.groupBy("term", "block").count().where("count > 1").count() == 0
    got = lists.select("term", "block", "df", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p")).select("term", "block", "df", "p.*").collect()
    expected = {(w, i, t.split().count(w), len(t.split())) for i, t in texts if t for w in set(t.split())}
    assert len(got) == len(expected) and {(r.term, r.docs, r.tfs, r.lengths) for r in got} == expected
    held = {}
    for r in got:
        held.setdefault(r.block, {})[r.docs] = r.lengths
    assert all(len(d) <= 8 and (sum(d.values()) <= 40 or len(d) == 1) for d in held.values())
