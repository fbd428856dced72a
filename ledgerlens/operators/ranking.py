"""Top rows per group, and capped result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group.

    Spark limits each group inside every task before the shuffle, so even a
    group holding most rows sends at most ``k`` rows per task. ``order`` ends
    in keys that leave no ties.
    """
    by = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by).cast("bigint")).where(F.col(rank) <= k)


def row_cap(df: DataFrame, order: list[Column], limit: int = 100, shown: int = 50) -> DataFrame:
    """The first ``shown`` of at most ``limit`` rows, with their number and the total.

    The windows see the capped rows only, never the whole input.
    """
    capped = df.orderBy(*order).limit(limit)
    return (
        capped.withColumn("row_no", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
        .withColumn("total_rows", F.count(F.lit(1)).over(Window.partitionBy()))
        .where(F.col("row_no") <= shown)
    )
