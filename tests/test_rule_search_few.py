"""A few grams are looked for one by one; the matches are those of LIKE either way."""

from ledgerlens.operators import rule_search

TEXTS = ["Cash Transaction\nReport to the bfiu", "a%b_c", "ab", "", None, "Ünïcode ſtraße transaction", "no match", "c\\d"]
PATTERNS = ["%cash transaction%", "%transaction%report%", "%a\\%b%", "%ab", "a_", "%", "%ünïcode%", "%ſ%", "%c\\\\d%", "%none of it%"]


def test_few_and_many_match_as_like(spark, monkeypatch):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    expected = sorted(
        (r[0], r[1]) for r in texts.crossJoin(patterns).where("lower(text) LIKE pattern").select("id", "pattern").collect()
    )
    plans = []
    for few in (rule_search.FEW, 0):
        monkeypatch.setattr(rule_search, "FEW", few)
        found = rule_search.like_matches(texts, ["id"], "text", patterns)
        assert sorted(tuple(r) for r in found.collect()) == expected
        plans.append(found._jdf.queryExecution().analyzed().toString())
    # With few of them no text is cut into all its trigrams.
    assert "regexp_extract_all" not in plans[0] and "regexp_extract_all" in plans[1]
