import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators.chunking import SEPARATORS, chunk_fixed, chunk_greedy, rows_to_text
from ledgerlens.plans.standins import spread
from ledgerlens.sources.pages import chunk_pages, document_pages
from ledgerlens.sources.tables import table
from tests import brute


def chunks_of(df, key="doc_id"):
    found = {}
    for row in df.collect():
        found.setdefault(row[key], []).append((row["chunk_ord"], row["chunk_text"]))
    return {k: [t for _, t in sorted(v)] for k, v in found.items()}


@pytest.fixture(scope="module")
def texts(spark, data):
    """Real documents with doubled line breaks, and short random strings full of separators."""
    rnd = random.Random(7)
    bits = ["a", "b ", ". ", ", ", "\n", "\n\n", ".", " ", "cc", "  ", ", , "]
    made = [
        (1_000_000 + i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 120))))
        for i in range(300)
    ]
    docs = table(spark, data, "documents").select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
    )
    return spread(docs.union(spark.createDataFrame(made, docs.schema)), "doc_id").cache()


@pytest.mark.parametrize("hard_split", [True, False])
@pytest.mark.parametrize(
    "size,separators", [(60, SEPARATORS), (7, SEPARATORS), (7, (". ", ", ")), (5, (", ",)), (60, ("\n",))]
)
def test_greedy_matches_brute_force(texts, size, separators, hard_split):
    got = chunks_of(
        chunk_greedy(texts, max_tokens=size, separators=separators, hard_split=hard_split)
    )
    for row in texts.collect():
        assert got.get(row.doc_id, []) == brute.pack(row.text, separators, size, hard_split)


def test_no_greedy_chunk_is_too_long(texts):
    for hard_split in (True, False):
        out = chunk_greedy(texts, max_tokens=9, hard_split=hard_split)
        worst = out.agg(F.max(text.token_count(F.col("chunk_text"))), F.max("n_tokens")).first()
        assert worst[0] <= 9 and worst[1] <= 9
        assert out.where(F.col("n_tokens") != text.token_count(F.col("chunk_text"))).count() == 0


def test_fixed_windows_at_the_bound(spark):
    rows = [(0, ""), (1, None), (2, "  \n "), (3, "w " * 500), (4, " w" * 501), (5, "one")]
    out = chunk_fixed(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = {}
    for r in out.collect():
        sizes.setdefault(r.doc_id, []).append(r.n_tokens)
    assert sizes == {3: [500], 4: [500, 1], 5: [1]}


def test_fixed_windows_rejoin_to_the_normalised_text(texts):
    got = chunks_of(chunk_fixed(texts, max_tokens=11))
    for row in texts.collect():
        assert " ".join(got.get(row.doc_id, [])) == " ".join(row.text.split())


@pytest.mark.parametrize("size,segment", [(5, 4), (3, 1), (50, 1024), (500, 7)])
def test_chunking_pages_equals_chunking_the_document(spark, size, segment):
    rnd = random.Random(size * 1000 + segment)
    bits = ["ab", "c", " ", "  ", "d e f ", "\n"]

    def page():
        if rnd.random() < 0.1:
            return rnd.choice([None, "", " "])
        return "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 6)))

    rows = [(d, i, page()) for d in range(25) for i in range(rnd.randint(1, 60))]
    pages = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    got = chunks_of(chunk_pages(pages, "doc_id", "page_no", "text", size, segment))
    places = {}
    for r in document_pages(pages, "doc_id", "page_no", "text", segment).orderBy("doc_id", "page_no").collect():
        # Whatever the number of pages, every page is a row that begins where the one before ended.
        assert r.char_start == len(places.get(r.doc_id, ""))
        places[r.doc_id] = places.get(r.doc_id, "") + r.text
    for d in range(25):
        expected = brute.page_windows([(p, t) for k, p, t in rows if k == d], size)
        assert got.get(d, []) == expected
        assert places.get(d, "") == "".join(t or "" for k, _, t in rows if k == d)


@pytest.mark.parametrize(
    "raw",
    [
        "<s><s> a</s>b",
        "see /g12 and /g",
        "page 38 of 86 here",
        "1 2 of 3 of 4",
        "x12 of 30, 12 of 30x, _1 of 2",
        "é12 of 30",
        "12 of 30   end ",
        "٣ of ٤ digits",
        "a\x1cb\x85c",
        "12 of 30 13 of 30",
        "3\nof\t4",
        "",
        "   ",
    ],
)
def test_clean_text(spark, raw):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.clean_text(F.col("t"))).first()[0] == brute.clean(raw)


def test_clean_text_on_all_documents(texts):
    for raw, cleaned in texts.select("text", text.clean_text(F.col("text"))).collect():
        assert cleaned == brute.clean(raw)


def test_clean_text_is_not_idempotent(spark):
    once = text.clean_text(F.lit("1 2 of 3 of 4"))
    assert spark.range(1).select(once, text.clean_text(once)).first()[:] == ("1 of 4", "")


def test_rows_to_text_skips_missing_and_blank(spark):
    df = spark.createDataFrame([("x", None, 5), (" ", "y", 0)], "a string, b string, c int")
    got = [r[0] for r in df.select(rows_to_text(df, "f.csv")).collect()]
    assert got == ["Source: f.csv\na: x\nc: 5", "Source: f.csv\nb: y\nc: 0"]


def test_excerpt_null_and_fence(spark):
    row = spark.range(1).select(
        text.excerpt(F.lit("ab")),
        text.excerpt(F.lit("x" * 600)),
        text.shown(F.lit(None).cast("int")),
        text.strip_sql_fence(F.lit("```sql\nSELECT 1\n```\n")),
        text.table_name(F.lit("str-filing kpi.csv")),
    ).first()
    assert row[:] == ("ab...", "x" * 500 + "...", "NULL", "SELECT 1", "str_filing_kpi")
