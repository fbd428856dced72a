"""One key with a third of all rows or more."""

from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.plans import standins
from ledgerlens.session import RUNTIME_SETTINGS, new_path
from ledgerlens.sources.pages import chunk_pages
from ledgerlens.sources.tables import table


def test_a_hot_order_is_split_in_the_join(spark, data):
    folder = new_path(spark, "skewed")
    hot = F.when(F.rand(3) < 0.5, F.lit(1)).otherwise(F.col("l_orderkey"))
    lines = table(spark, data, "lineitem").withColumn("l_orderkey", hot.cast("long"))
    lines = lines.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("_n")
    lines.repartition(16).write.parquet(f"{folder}/lineitem.parquet")
    for name in ("orders", "supplier", "nation"):
        table(spark, data, name).write.parquet(f"{folder}/{name}.parquet")

    expected = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .agg(
            F.count_distinct("l_orderkey", "l_suppkey"),
            F.count_if(F.datediff("l_shipdate", "o_orderdate") > standins.SLA_DAYS),
        )
        .first()
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = standins.str_filing(spark, folder).agg(F.sum("str_filed_count"), F.sum("str_sla_breaches"))
        got = df.collect()[0]
        final = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert got[:] == expected[:]
    assert "skew=true" in final


def test_settings_reach_the_session(spark):
    for key, value in RUNTIME_SETTINGS.items():
        assert spark.conf.get(key) == value


def test_one_document_with_most_pages(spark):
    pages = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("doc_id"),
        F.col("id").alias("page_no"),
        F.concat(F.col("id").cast("string"), F.lit(" x")).alias("text"),
    )
    out = chunk_pages(pages, "doc_id", "page_no", "text", 100)
    hot = out.where("doc_id = -1")
    # 20,000 pages; each 'x' runs into the next page's number, so n + 1 words.
    assert hot.count() == 201
    assert hot.agg(F.sum(text.token_count(F.col("chunk_text")))).first()[0] == 20_001
