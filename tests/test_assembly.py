import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.operators import assembly, kpi
from ledgerlens.operators.ranking import row_cap, top_per_group

HITS = "qid long, rank long, source_file string, file_type string, text string"


def test_citation_blocks(spark):
    hits = spark.createDataFrame(
        [(1, 2, None, "PDF", "b  b"), (1, 1, "f.pdf", None, "<s>a"), (2, 1, "g", "CSV", "c")], HITS
    )
    got = {r.qid: r.doc_context for r in assembly.citation_blocks(hits, "qid").collect()}
    assert got == {1: "[Unknown: f.pdf]\na\n\n---\n\n[PDF: Unknown]\nb b", 2: "[CSV: g]\nc"}
    raw = {r.qid: r.doc_context for r in assembly.citation_blocks(hits, "qid", clean=False).collect()}
    assert raw[1].startswith("[Unknown: f.pdf]\n<s>a")


def test_keyword_blocks_cut_after_cleaning(spark):
    hits = spark.createDataFrame([(1, 1, "f", "PDF", "<s>" + "x" * 600)], HITS)
    hits = hits.withColumn("excerpt", text.excerpt(text.clean_text(F.col("text"))))
    got = assembly.keyword_blocks(hits, "qid").first().keyword_context
    assert got == "[PDF: f]\n" + "x" * 500 + "..."


def block(spark, n):
    df = spark.range(n).select("id", F.when(F.col("id") != 1, F.col("id") / 2).alias("half"))
    return assembly.result_block(df, [F.asc("id")], "q").first().block


def test_result_block_layouts(spark):
    assert block(spark, 0) == "SQL Query Executed:\nq\n\nNo results found for this query."
    assert block(spark, 2) == (
        "SQL Query Executed:\nq\n\nResults:\nid | half\n----+-----\n0 | 0.00\n1 | NULL\n\nTotal rows: 2"
    )
    assert "Showing" not in block(spark, 50)
    longer = block(spark, 51)
    assert "\n49 | 24.50\n(Showing first 50 of 51 rows)\n\nTotal rows: 51" in longer
    assert block(spark, 500).endswith("(Showing first 50 of 100 rows)\n\nTotal rows: 100")


def test_row_cap(spark):
    got = row_cap(spark.range(300), [F.desc("id")]).collect()
    assert [r.id for r in got] == list(range(299, 249, -1))
    assert {r.total_rows for r in got} == {100}


def test_assembled_sections(spark):
    questions = spark.createDataFrame(
        [
            (1, True, False),
            (2, False, True),
            (3, True, True),
            (4, False, False),
            (5, False, True),
            (6, False, False),
        ],
        "qid long, needs_sql boolean, needs_docs boolean",
    )
    every = [(i,) for i in range(1, 5)]
    sql = spark.createDataFrame([(1, "S"), (3, "S")], "qid long, block string")
    docs = spark.createDataFrame([(i, "D") for (i,) in every], "qid long, doc_context string")
    kw = spark.createDataFrame([(2, "K"), (4, "K"), (5, "K")], "qid long, keyword_context string")
    out = assembly.assemble_context(questions, "qid", sql, docs, kw)
    got = {r.qid: r.context for r in out.collect()}
    start = "\n\n" + "=" * 70
    extra = "\n[Additional Keyword Matches]\nK"
    assert got == {
        1: start + "[SQL Query Results]\nS",
        2: start + "[Document Context]\nD\n" + extra,
        3: start + "[SQL Query Results]\nS\n\n[Document Context]\nD",
        4: start + "[Document Context]\nD",
        5: start + "[Document Context]\n" + extra,
        6: start,
    }


def test_cited_sources(spark):
    questions = spark.createDataFrame([(1,), (2,)], "qid long")
    hits = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b")], "qid long, source_file string")
    got = {r.qid: r.sources for r in assembly.cited_sources(questions, hits, "qid").collect()}
    assert got == {1: "a, b", 2: assembly.NO_SOURCE}


def test_top_per_group_of_a_hot_group(spark):
    df = spark.range(100_000).select((F.col("id") % 3 * 0).alias("g"), "id").union(
        spark.createDataFrame([(1, 5)], "g long, id long")
    )
    got = sorted((r.g, r.id, r["rank"]) for r in top_per_group(df, "g", [F.desc("id")], 2).collect())
    assert got == [(0, 99_998, 2), (0, 99_999, 1), (1, 5, 1)]


def test_rates_are_ratios_of_sums_and_survive_zero(spark):
    kyc = spark.createDataFrame(
        [("a", 1, 0), ("a", 0, 3), ("b", 0, 0)],
        "bank_name string, edd_completed long, edd_pending long",
    )
    got = {r.bank_name: r.completion_rate for r in kpi.edd_completion_rate(kyc).collect()}
    assert got == {"a": 0.25, "b": None}
    filing = spark.createDataFrame(
        [("a", 10.0, 1), ("a", 1.0, 9), ("a", None, 50)],
        "bank_name string, avg_str_filing_days double, str_filed_count long",
    )
    assert kpi.str_timeliness(filing).first()[:] == ("a", 10, 1.9)


@pytest.mark.parametrize(
    "quarter,months", [("2025-Q1", ["2025-01", "2025-02", "2025-03"]), ("2024-Q4", ["2024-10", "2024-11", "2024-12"])]
)
def test_quarters(spark, quarter, months):
    from ledgerlens.functions.calendar import months_of_quarter, quarter_of_month

    assert months_of_quarter(quarter) == months
    df = spark.createDataFrame([(m,) for m in months], "m string")
    assert {r[0] for r in df.select(quarter_of_month(F.col("m"))).collect()} == {quarter}
