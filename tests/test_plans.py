"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import top_per_group
from ledgerlens.plans import standins
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_by_row_python(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(QUERIES["f1_equality_conjunction"](spark, data))
    assert "EqualTo(l_returnflag,R)" in text and "EqualTo(l_linestatus,F)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
    }


def test_months_prune_the_orders_scan(spark, data):
    text = plan(QUERIES["k2_most_unreported_ctrs"](spark, data))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", text)
    assert "l_tax" not in text and "o_totalprice" not in text


def test_branch_filters_reach_the_small_tables_first(spark, data):
    text = plan(QUERIES["k1_branch_breaches"](spark, data))
    assert "EqualTo(s_name,Supplier#000000000)" in text
    assert "EqualTo(n_name,NATION_15)" in text
    assert "LeftSemi" in text


def test_order_by_limit_keeps_only_the_top(spark, data):
    for name in ("v7_order_limit", "c6_chunk_preview", "k2_most_unreported_ctrs"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, data))


def test_groups_are_cut_before_the_shuffle(spark):
    text = plan(top_per_group(spark.range(10).withColumn("g", F.col("id") % 2), "g", [F.asc("id")], 3))
    exchange = text.index("Exchange")
    assert text.index("WindowGroupLimit", exchange) > exchange  # below the exchange too


def test_ranking_does_not_read_texts(spark, data):
    from ledgerlens.operators.vector_search import vector_topk

    hits = vector_topk(standins.embedded_items(spark, data), standins.corpus_vectors(spark, data))
    schemas = re.findall(r"ReadSchema: (\S+)", plan(hits))
    assert schemas and not any("text" in schema for schema in schemas)


def test_distinct_orders_need_no_extra_shuffle(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(standins.str_filing(spark, data))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Expand" not in text
    # Lines and orders are placed by order once; grouping per order reuses that.
    by_order = re.findall(r"Exchange hashpartitioning\(l_orderkey#[^)]*\), ENSURE_REQUIREMENTS", text)
    assert len(by_order) == 2


def test_text_work_uses_all_cores_on_one_file(spark, data):
    assert standins.corpus(spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert table(spark, data, "documents").rdd.getNumPartitions() == 1


def test_texts_of_hits_are_not_shuffled(spark, data):
    """With broadcasts by size off: the winners' measured size decides, and the texts stay in place."""
    from ledgerlens.plans import answer

    asked = answer.routed(standins.embedded_questions(spark, data))
    chunks = table(spark, data, "documents").select(
        "doc_id", F.lit(0).alias("chunk_ord"), F.col("source").alias("source_file"), F.col("lang").alias("file_type"), F.col("text").alias("chunk_text")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(answer.document_hits(asked, standins.corpus_vectors(spark, data), chunks))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_the_corpus_is_not_copied_per_part_of_queries(spark, data):
    from ledgerlens.operators.blocked_topk import Limits
    from ledgerlens.operators.vector_search import vector_topk

    vectors = standins.corpus_vectors(spark, data)
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    # One part: the corpus is scored where it is read. Several: each is written before the next is collected.
    text = plan(vector_topk(queries, vectors))
    assert "Generate" not in text and text.count("MapInArrow") == 1
    parts = plan(vector_topk(queries, vectors, limits=Limits(broadcast_bytes=40_000)))
    assert "Union" in parts and parts.count("FileScan") > 1 and "Generate" not in parts and "Exchange" not in parts
