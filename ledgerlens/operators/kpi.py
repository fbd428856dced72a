"""KPI queries: filters, grouped ratios and rankings over the five KPI tables.

Rates are ratios of sums, never means of ratios. Every ranking ends in tie
keys so that it is the same on every run. All grouping is by Spark's partial
and final aggregation, so a bank or month holding most rows is summed where
it lies before anything is shuffled.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.calendar import months_of_quarter, quarter_of_month, ratio

BRANCH = ("bank_name", "branch")


def equal_to(**values: str) -> Column:
    """column = value AND column = value ..."""
    return functools.reduce(operator.and_, [F.col(c) == F.lit(v) for c, v in values.items()])


def in_quarter(month: str, quarter: str) -> Column:
    """Months of a quarter as an IN list."""
    return F.col(month).isin(months_of_quarter(quarter))


def holds_in_order(low: Column, pattern: str) -> Column:
    """``low LIKE '%a%b%'`` without backtracking.

    Each part is looked for after the first occurrence of the one before it,
    so a long text is read once per part. The regex that LIKE compiles to
    starts again from every occurrence of the first part. The plain test that
    all parts occur is the fastest and settles most texts. Other pattern
    forms use LIKE itself.
    """
    parts = pattern.split("%")
    if parts[0] or parts[-1] or not all(parts[1:-1]) or "_" in pattern or "\\" in pattern:
        return low.like(pattern)
    condition, start = F.lit(True), F.lit(1)
    for part in parts[1:-1]:
        condition &= F.contains(low, F.lit(part))
    if len(parts) > 3:
        for part in parts[1:-1]:
            at = F.position(F.lit(part), low, start)
            condition, start = condition & (at > 0), at + len(part)
    return condition


def folded(text: Column, test: Callable[[Column], Column]) -> Column:
    """Apply ``test`` to the lower-cased text, which is computed once however often it is used."""
    return F.exists(F.array(F.lower(text)), test)


def topic_matches(low: Column, required: str, any_of: tuple[str, ...] = ()) -> Column:
    """LIKE on a lower-cased text: the required pattern and, if given, one of the others."""
    condition = holds_in_order(low, required)
    if any_of:
        condition &= functools.reduce(operator.or_, [holds_in_order(low, p) for p in any_of])
    return condition


def any_topic(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def branch_month_detail(kpi: DataFrame, bank_name: str, branch: str, month: str) -> DataFrame:
    """All measures of one branch in one month."""
    return kpi.where(equal_to(bank_name=bank_name, branch=branch, month=month))


def branch_quarter_detail(kpi: DataFrame, branch: str, quarter: str) -> DataFrame:
    """All monthly rows of one branch in one quarter."""
    return kpi.where((F.col("branch") == branch) & in_quarter("month", quarter))


def most_unreported_ctrs(ctr: DataFrame, quarter: str, rows: int = 10) -> DataFrame:
    return (
        ctr.where(in_quarter("month", quarter))
        .groupBy(*BRANCH)
        .agg(
            F.sum("ctrs_unreported").alias("total_unreported_ctrs"),
            F.sum("ctrs_filed").alias("total_filed_ctrs"),
        )
        .orderBy(F.desc("total_unreported_ctrs"), *BRANCH)
        .limit(rows)
    )


def edd_completion_rate(kyc: DataFrame) -> DataFrame:
    done, pending = F.sum("edd_completed"), F.sum("edd_pending")
    return kyc.groupBy("bank_name").agg(
        done.alias("edd_completed"),
        pending.alias("edd_pending"),
        ratio(done, done + pending).alias("completion_rate"),
    )


def most_str_breaches(str_filing: DataFrame, rows: int = 1) -> DataFrame:
    return (
        str_filing.groupBy(*BRANCH)
        .agg(F.sum("str_sla_breaches").alias("total_breaches"))
        .orderBy(F.desc("total_breaches"), *BRANCH)
        .limit(rows)
    )


def training_below(training: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Branches whose trained share is below the threshold."""
    trained, staff = F.sum("staff_trained_aml_cft"), F.sum("staff_total")
    return (
        training.groupBy(*BRANCH)
        .agg(
            staff.alias("staff_total"),
            trained.alias("staff_trained"),
            ratio(trained, staff).alias("training_rate"),
        )
        .where(F.col("training_rate") < threshold)
    )


def ctr_filing_rate(ctr: DataFrame) -> DataFrame:
    filed, missing = F.sum("ctrs_filed"), F.sum("ctrs_unreported")
    return ctr.groupBy(*BRANCH).agg(
        filed.alias("ctrs_filed"),
        missing.alias("ctrs_unreported"),
        ratio(filed, filed + missing).alias("filing_rate"),
    )


def sanctions_rates(sanctions: DataFrame) -> DataFrame:
    screened = F.sum("transactions_screened")
    return sanctions.groupBy(*BRANCH).agg(
        screened.alias("transactions_screened"),
        ratio(F.sum("sanctions_hits_flagged"), screened).alias("hit_rate"),
        ratio(F.sum("sla_breaches"), screened).alias("breach_rate"),
    )


def str_timeliness(str_filing: DataFrame) -> DataFrame:
    """Mean filing days weighted by filings; rows without a mean carry no weight."""
    weight = F.when(F.col("avg_str_filing_days").isNotNull(), F.col("str_filed_count"))
    return str_filing.groupBy("bank_name").agg(
        F.sum(weight).alias("filings"),
        ratio(F.sum(F.col("avg_str_filing_days") * weight), F.sum(weight), 4).alias("avg_days"),
    )


def high_risk_customers(kyc: DataFrame) -> DataFrame:
    return kyc.groupBy("bank_name", "month").agg(
        F.sum("high_risk_customers").alias("high_risk_customers")
    )


def quarterly_volumes(str_filing: DataFrame) -> DataFrame:
    return (
        str_filing.groupBy("bank_name", quarter_of_month(F.col("month")).alias("quarter"))
        .agg(
            F.sum("str_filed_count").alias("str_filed_count"),
            F.sum("str_sla_breaches").alias("str_sla_breaches"),
        )
    )


# What counts as a gap, per monthly KPI table.
GAP_MEASURES = {
    "str_filing_kpi": "str_sla_breaches",
    "ctr_reporting_kpi": "ctrs_unreported",
    "kyc_edd_kpi": "edd_pending",
    "sanctions_screening_kpi": "sla_breaches",
}


def gap_flag(kpi: DataFrame, measure: str) -> DataFrame:
    """Mark each row as a gap or not."""
    return kpi.withColumn("gap", F.when(F.col(measure) > 0, "GAP").otherwise("OK"))


def compliance_gaps(tables: dict[str, DataFrame]) -> DataFrame:
    """Gap counts of all monthly tables side by side per bank, branch and month.

    The tables are stacked and summed, not joined: no fan-out, one shuffle,
    and a key missing in one table still shows.
    """
    stacked = functools.reduce(
        DataFrame.unionByName,
        [
            kpi.select(
                *BRANCH,
                "month",
                *[
                    (F.col(m) if t == name else F.lit(0).cast("bigint")).alias(f"{t}_gaps")
                    for t, m in GAP_MEASURES.items()
                ],
            )
            for name, kpi in tables.items()
        ],
    )
    gaps = [f"{t}_gaps" for t in GAP_MEASURES]
    total = functools.reduce(operator.add, [F.col(g) for g in gaps])
    return (
        stacked.groupBy(*BRANCH, "month")
        .agg(*[F.sum(g).alias(g) for g in gaps])
        .withColumn("total_gaps", total)
        .where(F.col("total_gaps") > 0)
    )
