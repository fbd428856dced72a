"""URL rules and the listed URLs, against a plain version and SQL."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries
from ledgerlens.llm.url_filter import judge_urls
from oracle.check import connect, differences

URLS = [
    None, "", "no scheme", "http://", "http://X.NET", "http://x.net/", "https://a.b.Example.NET/en/1?x=2#f", "http://example.net/en", "http://badexample.net/en/",
    "http://example.com/de/a", "http://www.example.com/fr/a", "http://org/fr/", "http://q.org/fr", "http://z.org?/fr/", "ftp://É.com/de/ ://x", "http://a.com/p//?b=2&a=1&utm_x=1&ref=q",
    "https://A.com/p?a=1&b=2#z", "http://a.com/p?a=1", "http://a.com/" + "x" * 50_000, "http://a.com/line\nbreak", "http://net/", "x://y://z.net/",
]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, rest = rest[:end], rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def canonical(url):
    host, path = parts(url)
    if not host:
        return ""
    after = url.split("://", 1)[1].split("#", 1)[0]
    query = after.split("?", 1)[1] if "?" in after else ""
    kept = sorted(p for p in query.split("&") if p and not p.startswith(("utm_", "ref=")))
    return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain(url, listed):
    host, path = parts(url)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    hit = canonical(url) != "" and canonical(url) in {canonical(u) for u in listed}
    return host, path, rule and rule.name, rule.verdict if rule else "block" if hit else "allow", hit and rule is None


@pytest.mark.parametrize("listed", [[], ["http://A.com/p/?a=1&b=2", "http://A.com/p/?a=1&b=2", None, "nothing", "http://x.net/"], URLS])
def test_matches_plain_version(spark, listed):
    rows = list(enumerate(URLS)) + [(5, URLS[5]), (None, URLS[16])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"_id": F.lit(1), "host": F.lit(2), "_block": F.lit(3), "listed": F.lit(4)})
    given = spark.createDataFrame([(u,) for u in listed], "url string")
    found = judge_urls(pages, given, queries.URL_RULES).collect()
    expected = [(i, *plain(u, listed)) for i, u in rows]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert judge_urls(pages.limit(0), given, queries.URL_RULES).count() == 0


def test_full_filter_changes_nothing(spark, monkeypatch):
    """With one block for everything nearly all URLs pass; the join removes the false ones."""
    from ledgerlens.llm import url_filter

    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), F.col("id").cast("string")).alias("url"))
    some = pages.where("page_id % 3 = 0").select("url")
    blocks = url_filter.bloom_filter
    monkeypatch.setattr(url_filter, "bloom_filter", lambda hashes: blocks(hashes, max_blocks=1))
    found = judge_urls(pages, some, queries.URL_RULES).collect()
    assert {r["page_id"] for r in found if r["listed"]} == set(range(0, 600, 3)) and len(found) == 600


def test_a_filter_that_is_too_large_for_a_broadcast(spark, monkeypatch):
    from ledgerlens.llm import url_filter

    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.com/"), F.col("id").cast("string")).alias("url"))
    found = judge_urls(pages, pages.where("page_id % 3 = 0").select("url"), queries.URL_RULES).collect()
    assert {r["page_id"] for r in found if r["listed"]} == set(range(0, 600, 3)) and len(found) == 600


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, data, name):
    assert differences(queries.QUERIES[name](spark, data), connect(data), queries.ORACLES[name]) is None
