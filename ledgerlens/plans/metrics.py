"""The metric part of questions: which KPI table, bank, branch and period are meant, and what the table says.

Facts of all five tables are stacked, and each has a key for every way to leave
its bank, its branch or its period open. What is asked for is one such key, or
several, so any number of questions meets the facts in an equi-join, once per
distinct key, and only what was met is summed.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.calendar import quarter_of_month
from ledgerlens.operators.assembly import EXECUTED, FIRST_ROWS, NO_ROWS, RESULTS, TOTAL_ROWS
from ledgerlens.operators.ranking import top_per_group
from ledgerlens.session import materialise

# The cap on a result's rows, and how many are shown.
ROWS, SHOWN = 100, 50
ANY = "*"


@dataclass(frozen=True)
class Metric:
    """A KPI table, the words that ask for it, its measures, and a figure: a numerator over a denominator.

    Rows come by the first measure, largest first.
    """

    table: str
    words: tuple[str, ...]
    measures: tuple[str, ...]
    figure: str
    parts: tuple[str, str]


# The five KPI tables. The first whose words a question has is meant; words count whole, with a
# plural. Shares and means are sums over sums, as means of means would weigh small months like large ones.
METRICS = (
    Metric("ctr_reporting_kpi", ("ctr", "cash transaction"), ("ctrs_unreported", "ctrs_filed", "txns_above_threshold"),
           "filing_rate", ("ctrs_filed", "ctrs_filed + ctrs_unreported")),
    Metric("kyc_edd_kpi", ("kyc", "edd", "due diligence"), ("edd_pending", "edd_completed", "high_risk_customers"),
           "completion_rate", ("edd_completed", "edd_completed + edd_pending")),
    Metric("sanctions_screening_kpi", ("sanction", "screening"), ("sla_breaches", "sanctions_hits_flagged", "transactions_screened"),
           "breach_rate", ("sla_breaches", "transactions_screened")),
    Metric("training_compliance_kpi", ("training", "trained"), ("staff_untrained", "staff_trained_aml_cft", "staff_total"),
           "training_rate", ("staff_trained_aml_cft", "staff_total")),
    Metric("str_filing_kpi", ("str", "suspicious transaction"), ("str_sla_breaches", "str_filed_count"),
           "avg_str_filing_days", ("avg_str_filing_days * str_filed_count", "CASE WHEN avg_str_filing_days IS NOT NULL THEN str_filed_count END")),
)
TRAINING_FLOOR = 0.95  # training rows are those below it
BROADCAST_BYTES = 64 << 20
_SUMS = ("a", "b", "c", "num", "den")


def metric_table(question: Column) -> Column:
    """The KPI table a question asks for by a whole word; missing if it names none."""
    low = F.lower(question)
    return functools.reduce(
        lambda out, m: F.when(low.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(m.words)})s?(?![\p{{L}}\p{{N}}])"), m.table).otherwise(out),
        reversed(METRICS),
        F.lit(None).cast("string"),
    )


def periods_of(question: Column) -> Column:
    """The months ``2025-03`` and quarters ``2025-Q1`` named, in order."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"(?i)\b(\d{4}-(?:q[1-4]|\d{2}))\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))


def stacked_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, bank_name, branch, month, quarter, a, b, c, num, den) of all five tables."""
    training = tables["training_compliance_kpi"]
    tables = tables | {
        "training_compliance_kpi": training.withColumn("month", F.lit(None).cast("string")).withColumn(
            "staff_untrained", F.col("staff_total") - F.col("staff_trained_aml_cft")
        ),
    }
    parts = []
    for metric in METRICS:
        df = tables[metric.table]
        quarter = F.col("quarter") if "quarter" in df.columns else quarter_of_month(F.col("month"))
        measures = [
            (F.col(metric.measures[i]).cast("bigint") if i < len(metric.measures) else F.lit(None).cast("bigint")).alias(x)
            for i, x in enumerate("abc")
        ]
        figure = [F.expr(e).cast("double").alias(x) for e, x in zip(metric.parts, ("num", "den"))]
        parts.append(df.select(F.lit(metric.table).alias("table"), "bank_name", "branch", "month", quarter.alias("quarter"), *measures, *figure))
    return functools.reduce(DataFrame.unionByName, parts)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s?.,!;:]+"), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    """Every run of ``n`` words with its place."""
    places = F.sequence(F.lit(0), F.size(words) - n)
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, n), " ").alias("run")))


def named(questions: DataFrame, key: str, question: str, names: DataFrame) -> DataFrame:
    """(key, banks, branches): the banks and branches a question names, in order, by an equi-join on its words.

    ``names`` has (kind, name). Runs of as many words as the longest name has
    are looked up, so the number of names does not matter. A name inside a
    longer one of its kind does not count there.
    """
    words = names.select("kind", "name", _words(F.col("name")).alias("_w")).select(
        "kind", "name", F.array_join("_w", " ").alias("_run"), F.size("_w").alias("_n")
    )
    longest = words.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    runs = [_runs(F.col("_w"), n) for n in range(1, longest + 1)]
    empty = F.array().cast("array<struct<at:int,run:string>>")
    every = [F.when(F.size("_w") >= n, r).otherwise(empty) for n, r in enumerate(runs, 1)]
    asked = questions.select(key, _words(F.col(question)).alias("_w"))
    asked = asked.select(key, F.explode(F.concat(*every) if every else empty).alias("_r")).select(key, "_r.at", F.col("_r.run").alias("_run"))
    hit = F.struct("at", F.col("_n").alias("n"), "name")
    hits = asked.join(words, "_run").groupBy(key, "kind").agg(F.array_sort(F.collect_set(hit)).alias("_hits"))
    inside = lambda x: F.exists("_hits", lambda y: (y["n"] > x["n"]) & (y["at"] <= x["at"]) & (y["at"] + y["n"] >= x["at"] + x["n"]))
    found = hits.select(key, "kind", F.array_distinct(F.transform(F.filter("_hits", lambda x: ~inside(x)), lambda x: x["name"])).alias("_names"))
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("_names")))
    return found.groupBy(key).agg(pick("bank").alias("banks"), pick("branch").alias("branches"))


def metric_answers(questions: DataFrame, tables: dict[str, DataFrame], key: str, question: str = "question") -> DataFrame:
    """(key, kpi_table, bank, branch, period, block) for every question.

    Names are looked for in the KPI tables themselves. A question that names
    several banks, branches or periods gets a result for each combination, in
    the order they are named. One that names no table, or whose key has no
    rows, gets the text for no results. Results are computed once per distinct
    (table, bank, branch, period), capped at 100 rows of which 50 are shown.

    The facts are written once; names and results are read from there. Facts
    meet the keys asked for before they are summed, without a shuffle while
    the keys are measured small.
    """
    facts = materialise(stacked_facts(tables), "facts")
    names = functools.reduce(
        DataFrame.unionByName,
        [facts.select(F.lit(kind).alias("kind"), F.col(c).alias("name")).distinct() for kind, c in (("bank", "bank_name"), ("branch", "branch"))],
    )
    q = F.col(question)
    none = F.array().cast("array<string>")
    asked = questions.select(key, metric_table(q).alias("table"), periods_of(q).alias("periods")).join(
        named(questions, key, question, names), key, "left"
    )
    parts = {"bank": "banks", "branch": "branches", "period": "periods"}
    asked = materialise(asked.select(key, "table", *[F.coalesce(c, none).alias(c) for c in parts.values()]), "asked")
    each = asked.where("table IS NOT NULL")
    for name, several in parts.items():
        given = F.when(F.size(several) > 0, F.col(several)).otherwise(F.array(F.lit(ANY)))
        each = each.select("*", F.posexplode(given).alias(f"_at_{name}", f"_{name}"))
    statement = F.concat_ws(", ", "table", *[F.concat(F.lit(f"{c} "), F.col(f"_{c}")) for c in parts])
    keys = [f"_{c}" for c in parts]
    each = materialise(each.select(key, "table", *keys, statement.alias("_statement"), F.array(*[f"_at_{c}" for c in parts]).alias("_order")), "keys")
    specs = each.select("table", "_statement", *keys).distinct()
    size = specs.agg(F.coalesce(F.sum(F.octet_length("_statement") * 2 + 64), F.lit(0))).first()[0]

    # A fact has a key with or without its bank, its branch, its month or quarter.
    open_ = lambda c: F.explode(F.array(F.col(c), F.lit(ANY)))
    periods = F.array_compact(F.array(F.col("month"), F.col("quarter"), F.lit(ANY)))
    opened = facts.withColumn("_bank", open_("bank_name")).withColumn("_branch", open_("branch")).withColumn("_period", F.explode(periods))
    rows = (
        opened.join(F.broadcast(specs) if size <= BROADCAST_BYTES else specs, ["table", *keys])
        .groupBy("table", "_statement", "bank_name", "branch")
        .agg(*[F.sum(x).alias(x) for x in _SUMS])
        .where((F.col("table") != "training_compliance_kpi") | (F.col("b") < TRAINING_FLOOR * F.col("c")))
    )
    top = top_per_group(rows, "_statement", [F.desc("a"), F.asc("bank_name"), F.asc("branch")], ROWS)
    figure = F.coalesce(F.round(F.col("num") / F.nullif(F.col("den"), F.lit(0.0)), 4).cast("decimal(18,4)").cast("string"), F.lit("NULL"))
    line = F.concat_ws(" | ", "bank_name", "branch", *[F.col(x).cast("string") for x in "abc"], figure)
    shown = F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN, F.struct("rank", line.alias("line")))))
    results = top.groupBy("table", "_statement").agg(shown.alias("_lines"), F.count(F.lit(1)).alias("_total"))
    header = functools.reduce(
        lambda out, m: F.when(F.col("table") == m.table, _header(m)).otherwise(out), METRICS, F.lit(None).cast("string")
    )
    note = F.when(F.col("_total") > SHOWN, F.format_string(FIRST_ROWS.format(SHOWN), F.col("_total"))).otherwise("")
    found = F.concat(
        F.lit(RESULTS), header, F.lit("\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"),
        note, F.lit(TOTAL_ROWS), F.col("_total").cast("string"),
    )
    nothing = F.lit("\n\n" + NO_ROWS)
    body = F.concat(F.lit(EXECUTED), F.col("_statement"), F.coalesce("_found", nothing))
    told = each.join(results.select("_statement", found.alias("_found")), "_statement", "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_order", body.alias("_body")))).alias("_blocks")
    )
    blocks = F.array_join(F.transform("_blocks", lambda b: b["_body"]), "\n\n")
    listed = [F.nullif(F.array_join(several, ", "), F.lit("")).alias(name) for name, several in parts.items()]
    return asked.join(told, key, "left").select(
        key, F.col("table").alias("kpi_table"), *listed, F.when(F.col("table").isNull(), NO_ROWS).otherwise(blocks).alias("block")
    )


def _header(metric: Metric) -> Column:
    columns = ("bank_name", "branch", *metric.measures, metric.figure)
    return F.lit(" | ".join(columns) + "\n" + "-+-".join("-" * len(c) for c in columns))
