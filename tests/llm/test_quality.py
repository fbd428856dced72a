"""Quality statistics against a plain version; the forest on held-out labels."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in lines
        lines.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked))


@pytest.mark.parametrize(
    "text",
    [None, "", " \n\t", "a", "a a a a", "a b c a b c d", "é# ñ|\n\né# ñ|\n \n ", "x\x0by\x0cz w v", "one two three one two three " * 3, "a\r\na\r\nb"],
)
def test_statistics(text):
    assert quality.base_statistics(text) == slow_statistics(text)


def test_forest_finds_outliers_on_held_out_rows():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (2000, 4)), rng.normal(6, 1, (200, 4))
    forest = quality.grow_forest(good[:1000])
    seen = np.r_[good[:1000], bad[:100]]
    bound = quality.calibrate(forest.score(seen), np.arange(len(seen)) < 1000, 20)
    assert (forest.score(good[1000:]) > bound).mean() < 0.02
    assert (forest.score(bad[100:]) > bound).mean() > 0.95


def test_calibration_without_bad_rows():
    assert quality.calibrate(np.array([0.3, 0.5]), np.array([True, True]), 20) == 0.5


def test_held_out_documents(spark, data):
    """Fitted on the labels of every other document, judged on the rest."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    rows = judged.select("quality", "kept").collect()
    good, bad = [[r[1] for r in rows if r[0] == q] for q in (1, 0)]
    assert np.mean(good) >= 0.95 and np.mean(bad or [0]) <= 0.2


def test_base_columns_over_whole_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 6000")
    texts = dict(docs.select("doc_id", "text").collect())
    found = quality.judge_quality(docs, quality.QualityModel(None, np.inf)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in found} == {i: slow_statistics(t) for i, t in texts.items()}
    assert all(r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"]) == (not r["kept"]) for r in found)


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, words), (3, words), (None, words + " # " * 500), (5, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_words": F.lit("x"), "kept": F.lit(1)})
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 0), (9, 1), (5, 0)], "doc_id bigint, quality int").withColumn("_quality", F.lit(0))
    model = quality.fit_quality(docs, labels)
    judged = quality.judge_quality(docs, model)
    assert sorted((r["doc_id"], r["kept"]) for r in judged.where("doc_id is not null").collect()) == [
        (1, False), (2, False), (3, True), (3, True), (5, False)]
    assert quality.fit_quality(docs, labels.limit(0)).forest is None
    assert quality.fit_quality(docs.limit(0), labels).forest is None
    assert quality.judge_quality(docs.limit(0), model).count() == 0


def test_the_bound_comes_from_all_labelled_rows(spark):
    """25,000 good rows and a bad one, which is not among the 20,000 of the smallest hashes."""
    plain = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("doc_id") * 100 + i).cast("string"))))
    odd = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("#" * 40), i.cast("string"))))
    ids = spark.range(25_000).select(F.col("id").alias("doc_id"))
    late = ids.orderBy(F.desc(F.xxhash64("doc_id"))).first()[0]
    bad = F.col("doc_id") == late
    docs = ids.withColumn("text", F.when(bad, odd).otherwise(plain))
    labels = ids.withColumn("quality", F.when(bad, 0).otherwise(1))
    model = quality.fit_quality(docs, labels)
    judged = quality.judge_quality(docs.where(bad | (F.col("doc_id") % 100 == 0)), model)
    assert [r["doc_id"] for r in judged.where("not kept").collect()] == [late]
    # All good rows count, drawn for a tree or not.
    counted = quality.calibrate(np.array([0.3, 0.5]), np.array([True, False]), 20, np.array([10, 1]))
    assert counted == quality.calibrate(np.array([0.3] * 10 + [0.5]), np.arange(11) < 10, 20)
