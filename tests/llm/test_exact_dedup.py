import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries
from ledgerlens.llm.exact_dedup import content_chunks, exact_dedup, one_space


def slow(rows):
    """Every row against the text itself."""
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup(docs, **more).collect()
    kept = [(r["keep_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str)


def corpus():
    rng = random.Random(5)
    words = ["aber", "on", "dirt", "as", "e", "lost ", "\n", "Ünder", "x\t", "hit", "\N{IDEOGRAPHIC FULL STOP}"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(60)]
    texts += [t.replace(" ", "\r\n") for t in texts[:20]] + [t + "z" for t in texts[:10]] + [t[:-1] for t in texts[:10]]
    return list(enumerate(texts + texts[:15]))


@pytest.mark.parametrize("bits", [64, 6, 2])
def test_small_chunks_and_weak_hashes_give_the_groups_of_equal_texts(spark, bits):
    rows = corpus()
    assert run(spark, rows, least=8, most=24, hash_bits=bits) == slow(rows)


def test_nulls_blanks_ties_repeats_and_an_empty_table(spark):
    rows = [(3, None), (1, ""), (2, " "), (5, "\n\t "), (4, "a b"), (4, "a b"), (None, "a  b"), (None, "c"), (None, "c"), (9, " a b")]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == []


def test_a_very_long_text_and_a_large_group(spark):
    long = "wanders on a\n" * 160_000
    rows = [(7, long), (2, long.replace("\n", " \n")), (3, long[:-2]), (4, "y" * 2_000_000), (5, "y" * 2_000_000)]
    rows += [(i, "the same") for i in range(100, 600)]
    assert run(spark, rows) == slow(rows)


def test_other_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, _row long, _recipe string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup(docs).collect()} == {(1, 1, True), (2, 1, False)}


def test_chunks_join_to_the_text_and_fall_into_step(spark):
    text = " ".join(random.Random(3).choices(["aber", "on", "dirt", "as", "lost", "hit", "b"], k=4000))
    docs = spark.createDataFrame([("q " * 31 + text,), (text,)], "text string")
    a, b = (r[0] for r in docs.select(content_chunks(one_space(F.col("text")), 64, 512)).collect())
    assert "".join(a) == "q " * 31 + text and "".join(b) == text and len(b) > 100
    assert len(set(b) - set(a)) < 10
    assert all(64 <= len(c) <= 520 for c in b[:-1])


def test_no_python_workers_and_no_texts_in_the_last_plan(spark, data):
    plan = queries.op11_exact_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "_chunk" not in plan.replace("_chunks", "")
