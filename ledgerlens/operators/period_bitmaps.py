"""Distinct customers over any months, from bitmaps per month that are merged and never counted twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.calendar import quarter_of_month

ALL = "all"


def month_bitmaps(facts: DataFrame, group: tuple[str, ...], month: str, customer: str) -> DataFrame:
    """(group, month, bucket, bits): which customers a group has in a month.

    A customer's number is a bucket and a bit in it; a bitmap holds 32,768
    numbers, so the longest row has 4 KB whatever a group holds, and rows of a
    group are merged where they are read. Missing numbers are no customer.
    """
    rows = facts.where(F.col(customer).isNotNull())
    return rows.groupBy(*group, month, F.bitmap_bucket_number(customer).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(customer)).alias("bits")
    )


def write_months(bitmaps: DataFrame, path: str, month: str = "month") -> None:
    """Store the months of ``bitmaps``, each in place of what was stored of it; other months stay."""
    # A row per group and bucket of a month: one file each.
    bitmaps.repartition(month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def stored_months(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored bitmaps, with the schema they were written with: months stay text."""
    return spark.read.schema(schema).parquet(path)


def distinct_customers(bitmaps: DataFrame, group: tuple[str, ...], period: Column) -> DataFrame:
    """(group, period, customers): merged over the months of a period, then counted."""
    merged = bitmaps.groupBy(*group, period.alias("period"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*group, "period").agg(F.sum(F.bitmap_count("bits")).alias("customers"))


def customers_by_period(bitmaps: DataFrame, group: tuple[str, ...], month: str = "month") -> DataFrame:
    """(group, period, customers) for every month, every quarter and all time.

    Each level is merged from the one below: months into quarters, quarters
    into the whole.
    """
    quarters = bitmaps.groupBy(*group, quarter_of_month(F.col(month)).alias("_quarter"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return (
        distinct_customers(bitmaps, group, F.col(month))
        .unionByName(distinct_customers(quarters, group, F.col("_quarter")))
        .unionByName(distinct_customers(quarters, group, F.lit(ALL)))
    )
