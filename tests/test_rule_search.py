"""Rules as a table against plain LIKE tests."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import rule_search
from ledgerlens.operators.keyword_search import TopicRule, first_hits_per_topic, keyword_batch
from ledgerlens.operators.rule_search import like_matches, rule_batch, rule_tables


def like(text, pattern):
    parts, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            parts.append(re.escape(pattern[i]))
        else:
            parts.append({"%": ".*", "_": "."}.get(c, re.escape(c)))
        i += 1
    return re.fullmatch("".join(parts), text, re.S) is not None


PATTERNS = ["%the%", "%", "", "a%", "%b", "_", "__%x", "%a_c%", "%ab", "%é%", "%100\\%%", "%\\_%", "%bank%of%", "%漢字%", "exact text", "%xyz%xyz%", "%a\nb%", "%q%"]
TEXTS = ["the bank of x", "a", "", "AB", "abc ab", "É", "100% _", "漢字", "exact text", "xyz xyz", "a\nb", None, "a%c axc", "THE", "q" * 5000 + "the"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_like_on_candidates_only(spark, monkeypatch, limit):
    monkeypatch.setattr(rule_search, "BROADCAST_BYTES", limit)
    rng = random.Random(3)
    texts = list(enumerate(TEXTS + ["".join(rng.choices("ab xyzthe_%\\", k=rng.randrange(12))) for _ in range(200)]))
    df = spark.createDataFrame(texts, "k long, t string").repartition(3)
    patterns = spark.createDataFrame([(p,) for p in PATTERNS * 2] + [(None,)], "pattern string")
    got = {(r.k, r.pattern) for r in like_matches(df, ["k"], "t", patterns).collect()}
    assert got == {(k, p) for k, t in texts if t is not None for p in PATTERNS if like(t.lower(), p)}


def some_rules(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 5)))
    return [
        TopicRule(f"t{i}", tuple(word() for _ in range(2)), f"%{word()}%", tuple(f"%{word()}%{word()}%" for _ in range(rng.randrange(3))), rng.random() < 0.2)
        for i in range(n)
    ]


def test_many_rules_as_the_plan_of_each_would(spark):
    rng, rules = random.Random(1), some_rules(60)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6)))
    chunks = spark.createDataFrame([(i, " ".join(word() for _ in range(40))) for i in range(150)], "id long, chunk_text string").repartition(3)
    questions = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(6)))) for i in range(80)] + [(99, None)], "q long, question string")
    expected = keyword_batch(questions, first_hits_per_topic(chunks, ["id"], rules=tuple(rules)), ["id"], "q", rules=tuple(rules))
    got = rule_batch(questions, chunks, rule_tables(spark, rules), ["id"], "q")
    rows = lambda df: sorted((r.q, r["rank"], r.id, r.chunk_text) for r in df.collect())
    assert rows(got) == rows(expected) and got.count() > 60


def test_thousands_of_rules_do_not_lengthen_the_plan(spark):
    chunks = spark.range(50).select(F.col("id"), F.concat(F.lit("abcd efgh "), F.col("id").cast("string")).alias("chunk_text"))
    sizes = []
    for n in (5, 3000):
        rules = rule_tables(spark, some_rules(n))
        df = like_matches(chunks, ["id"], "chunk_text", rules.patterns)
        assert (df.count() > 0) == (n == 3000)
        sizes.append(len(df._jdf.queryExecution().analyzed().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_no_rules_and_no_texts(spark):
    chunks = spark.createDataFrame([], "id long, chunk_text string")
    asked = spark.createDataFrame([(1, "ctr")], "q long, question string")
    assert rule_batch(asked, chunks, rule_tables(spark), ["id"], "q").count() == 0
    full = spark.createDataFrame([(1, "cash transaction report monthly ctr")], "id long, chunk_text string")
    rules = rule_tables(spark)
    assert rule_batch(asked, full, rules, ["id"], "q").count() == 1
    none = rule_search.Rules(rules.triggers.where("false"), rules.patterns.where("false"))
    assert rule_batch(asked, full, none, ["id"], "q").count() == 0
