import os
import random

from pyspark.sql import functions as F

from ledgerlens.operators.period_bitmaps import customers_by_period, month_bitmaps, stored_months, write_months
from ledgerlens.session import new_path


def facts(spark, rows):
    return spark.createDataFrame(rows, "bank string, month string, customer long")


def counted(df):
    return {(r.bank, r.period): r.customers for r in df.collect()}


def slow(rows):
    seen = {}
    for bank, month, customer in rows:
        if customer is not None:
            quarter = f"{month[:4]}-Q{(int(month[5:]) + 2) // 3}"
            for period in (month, quarter, "all"):
                seen.setdefault((bank, period), set()).add(customer)
    return {k: len(v) for k, v in seen.items()}


def some(n=3000, seed=0):
    rng = random.Random(seed)
    months = [f"{y}-{m:02d}" for y in (2024, 2025) for m in range(1, 13)]
    # Several buckets of 32,768 numbers, their edges, a hot bank, and missing customers.
    numbers = [1, 32768, 32769, 65536, 65537, 10**12, None] + [rng.randrange(1, 200_000) for _ in range(300)]
    return [(rng.choice(["hot"] * 5 + ["x", None]), rng.choice(months), rng.choice(numbers)) for _ in range(n)]


def test_against_sets(spark):
    rows = some()
    assert counted(customers_by_period(month_bitmaps(facts(spark, rows), ("bank",), "month", "customer"), ("bank",))) == slow(rows)


def test_a_month_is_stored_again_alone(spark):
    rows, path = some(500), new_path(spark, "months")
    bitmaps = month_bitmaps(facts(spark, rows), ("bank",), "month", "customer")
    write_months(bitmaps, path)
    folder = path.removeprefix("file:")
    before = {m: sorted(os.listdir(f"{folder}/{m}")) for m in os.listdir(folder) if m.startswith("month=")}
    late = [r for r in rows if r[1] != "2024-05"] + [("hot", "2024-05", 7), ("x", "2024-05", 10**9)]
    again = facts(spark, late).where("month = '2024-05'")
    write_months(month_bitmaps(again, ("bank",), "month", "customer"), path)
    after = {m: sorted(os.listdir(f"{folder}/{m}")) for m in before}
    assert {m for m in before if before[m] != after[m]} == {"month=2024-05"}
    assert counted(customers_by_period(stored_months(spark, path, bitmaps.schema), ("bank",))) == slow(late)


def test_bitmaps_are_small_whatever_a_group_holds(spark):
    hot = spark.range(1, 100_001).select(F.lit("hot").alias("bank"), F.lit("2024-01").alias("month"), F.col("id").alias("customer"))
    bitmaps = month_bitmaps(hot.union(hot), ("bank",), "month", "customer")
    assert bitmaps.count() == 4 and bitmaps.agg(F.max(F.length("bits"))).first()[0] == 4096
    assert counted(customers_by_period(bitmaps, ("bank",))) == {("hot", p): 100_000 for p in ("2024-01", "2024-Q1", "all")}


def test_no_facts(spark):
    assert customers_by_period(month_bitmaps(facts(spark, []), ("bank",), "month", "customer"), ("bank",)).count() == 0
