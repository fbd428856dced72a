"""The metric part of questions."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import metrics

MONTHLY = "bank_name string, branch string, month string, a long, b long, c long"


@pytest.fixture(scope="module")
def tables(spark):
    def monthly(metric, rows):
        df = spark.createDataFrame(rows, MONTHLY)
        names = dict(zip("abc", metric))
        return df.withColumnsRenamed(names)

    rows = [("Bank Asia", "Main Branch", "2025-01", 3, 5, 1), ("Bank Asia", "Dhaka", "2025-02", 9, 1, 0), ("Asia", "Dhaka", "2025-04", 2, 2, 2)]
    training = [("Bank Asia", "Dhaka", "2025-Q1", 10, 9), ("Asia", "Dhaka", "2025-Q1", 10, 10)]
    return {
        "ctr_reporting_kpi": monthly(("ctrs_unreported", "ctrs_filed", "txns_above_threshold"), rows),
        "kyc_edd_kpi": monthly(("edd_pending", "edd_completed", "high_risk_customers"), rows),
        "sanctions_screening_kpi": monthly(("sla_breaches", "sanctions_hits_flagged", "transactions_screened"), rows),
        "str_filing_kpi": monthly(("str_sla_breaches", "str_filed_count", "unused"), rows).withColumn(
            "avg_str_filing_days", F.when(F.col("month") != "2025-04", F.col("str_filed_count") * 2.5)
        ),
        "training_compliance_kpi": spark.createDataFrame(training, "bank_name string, branch string, quarter string, staff_total long, staff_trained_aml_cft long"),
    }


# Questions with the table, bank, branch and period that they mean.
GOLDEN = {
    "Which branches have staff training below 95%?": ("training_compliance_kpi", None, None, None),
    "What is the sanctions hit rate?": ("sanctions_screening_kpi", None, None, None),
    "What is the EDD completion rate?": ("kyc_edd_kpi", None, None, None),
    "Which branch of Bank Asia has the most STR breaches?": ("str_filing_kpi", "Bank Asia", None, None),
    "Compare CTR filing across branches in 2025-Q1": ("ctr_reporting_kpi", None, None, "2025-Q1"),
    "CTRs of the main  branch, 2025-01?": ("ctr_reporting_kpi", None, "Main Branch", "2025-01"),
    "ctr for Asia at Dhaka.": ("ctr_reporting_kpi", "Asia", "Dhaka", None),
    "How many people work here?": (None, None, None, None),
    "How many administration staff work in each district?": (None, None, None, None),
    "What is the most restrictive registration standard?": (None, None, None, None),
    "Compare STRs of Asia and Bank Asia in 2025-Q2 and 2025-01, then 2025-Q2 again": ("str_filing_kpi", "Asia, Bank Asia", None, "2025-Q2, 2025-01"),
    "": (None, None, None, None),
}


@pytest.fixture(scope="module")
def answers(spark, tables):
    asked = spark.createDataFrame(list(enumerate(GOLDEN)) + [(99, None), (100, "CTR in 1999-01")], "id long, question string")
    return {r["id"]: r for r in metrics.metric_answers(asked, tables, "id").collect()}


def test_table_and_names(answers):
    for i, expected in enumerate(GOLDEN.values()):
        r = answers[i]
        assert (r["kpi_table"], r["bank"], r["branch"], r["period"]) == expected
    assert len(answers) == len(GOLDEN) + 2


def test_no_metric_is_no_evidence(answers):
    for i in (7, 8, 9, 11, 99):
        assert answers[i]["block"] == metrics.NO_ROWS
    assert answers[100]["block"].endswith(metrics.NO_ROWS) and "ctr_reporting_kpi" in answers[100]["block"]


def test_rows(answers):
    assert answers[0]["block"].splitlines()[6:] == ["Bank Asia | Dhaka | 1 | 9 | 10 | 0.9000", "", "Total rows: 1"]
    # Mean days are weighted by filings: 2.5 for the one, 12.5 for the other branch.
    assert answers[3]["block"].splitlines()[4] == "bank_name | branch | str_sla_breaches | str_filed_count | avg_str_filing_days"
    assert answers[3]["block"].splitlines()[6:] == ["Bank Asia | Dhaka | 9 | 1 | 2.5000", "Bank Asia | Main Branch | 3 | 5 | 12.5000", "", "Total rows: 2"]
    assert answers[4]["block"].splitlines()[6:8] == ["Bank Asia | Dhaka | 9 | 1 | 0 | 0.1000", "Bank Asia | Main Branch | 3 | 5 | 1 | 0.6250"]
    assert answers[6]["block"].splitlines()[6:] == ["Asia | Dhaka | 2 | 2 | 2 | 0.5000", "", "Total rows: 1"]


def test_several_names_and_periods_are_all_answered(answers):
    blocks = answers[10]["block"].split(metrics.EXECUTED)[1:]
    told = [b.splitlines()[0] for b in blocks]
    assert told == [f"str_filing_kpi, bank {b}, branch *, period {p}" for b in ("Asia", "Bank Asia") for p in ("2025-Q2", "2025-01")]
    assert "Asia | Dhaka | 2 | 2 | NULL" in blocks[0] and metrics.NO_ROWS in blocks[1] and metrics.NO_ROWS in blocks[2]
    assert "Bank Asia | Main Branch | 3 | 5 | 12.5000" in blocks[3]


def test_facts_are_read_once_and_met_before_they_are_summed(spark, data):
    from ledgerlens.plans import standins

    df = metrics.metric_answers(standins.metric_turns(spark, data), standins.kpi_tables(spark, data), "turn_id")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and "events" not in text


def test_caps(spark, tables):
    many = [("B", f"br{i:03}", "2025-01", i, 0, 0) for i in range(120)]
    ctr = spark.createDataFrame(many, MONTHLY).withColumnsRenamed(dict(zip("abc", metrics.METRICS[0].measures)))
    asked = spark.createDataFrame([(1, "ctr")], "id long, question string")
    block = metrics.metric_answers(asked, tables | {"ctr_reporting_kpi": ctr}, "id").first()["block"]
    assert "(Showing first 50 of 100 rows)" in block and block.endswith("Total rows: 100") and block.count("B | br") == 50
