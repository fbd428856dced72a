"""The KPI tables, texts and questions, derived from the driver's tables.

Facts are summed per supplier key, or per customer group, before the small
name tables are joined. A filter on a branch is applied to the facts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.calendar import in_months, month_label, month_number, quarter_of_month
from ledgerlens.operators.chunking import chunk_fixed
from ledgerlens.session import materialise
from ledgerlens.sources.tables import table

# Stand-in limits, chosen so that about a tenth of the rows passes.
SLA_DAYS = 365
CTR_AMOUNT = 94_700
SCREENING_VALUE = 113
TRAINING_VALUE = 80


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The driver's tables are single small files, each read by one task; this deals their rows to all cores.

    A matter of these inputs only: the operators never do it, as a table of
    many files has many tasks. ``keys`` are near-unique.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() > 1 else df.repartition(cores, *keys)


def branches(
    spark: SparkSession, sf_dir: str, bank_name: str | None = None, branch: str | None = None
) -> DataFrame:
    """supplier -> (bank_name, branch): the nation's and the supplier's names."""
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.col("s_name").alias("branch")
    )
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("bank_name")
    )
    if branch is not None:
        supplier = supplier.where(F.col("branch") == branch)
    if bank_name is not None:
        nation = nation.where(F.col("bank_name") == bank_name)
    return supplier.join(nation, "s_nationkey").select("l_suppkey", "bank_name", "branch")


def _line_facts(
    spark: SparkSession, sf_dir: str, columns: list[str], keys: DataFrame | None, months: list[str] | None
) -> DataFrame:
    lines = spread(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *columns),
        "l_orderkey",
        "l_suppkey",
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"
    )
    if keys is not None:
        lines = lines.join(keys.select("l_suppkey"), "l_suppkey", "left_semi")
    if months is not None:
        orders = orders.where(in_months(F.col("o_orderdate"), months))
    return lines.join(orders, "l_orderkey").withColumn("_month", month_number(F.col("o_orderdate")))


_STR_COLUMNS = ["l_shipdate"]
_CTR_COLUMNS = ["l_linestatus", "l_returnflag", "l_extendedprice"]
_STR_MEASURES = ["str_filed_count", "avg_str_filing_days", "str_sla_breaches"]
_CTR_MEASURES = ["ctrs_filed", "ctrs_unreported", "txns_above_threshold"]


def _line_kpis(
    spark: SparkSession,
    sf_dir: str,
    columns: list[str],
    measures: list[str],
    bank_name: str | None,
    branch: str | None,
    months: list[str] | None,
) -> DataFrame:
    """The chosen measures of order lines per bank, branch and month, in one pass."""
    names = branches(spark, sf_dir, bank_name, branch)
    restricted = bank_name is not None or branch is not None
    facts = _line_facts(spark, sf_dir, columns, names if restricted else None, months)
    per_order, total = [], []
    if "l_shipdate" in columns:
        days = F.datediff("l_shipdate", "o_orderdate")
        per_order += [
            F.sum(F.when(days >= 0, days)).alias("_days"),
            F.count_if(days >= 0).alias("_dated"),
            F.count_if(days > SLA_DAYS).alias("_late"),
        ]
        mean = F.sum("_days").cast("double") / F.nullif(F.sum("_dated"), F.lit(0))
        total += [
            F.count(F.lit(1)).alias("str_filed_count"),
            mean.alias("avg_str_filing_days"),
            F.sum("_late").alias("str_sla_breaches"),
        ]
    if "l_linestatus" in columns:
        per_order += [
            F.count_if(F.col("l_linestatus") == "F").alias("_filed"),
            F.count_if(F.col("l_returnflag") == "R").alias("_unreported"),
            F.count_if(F.col("l_extendedprice") > CTR_AMOUNT).alias("_above"),
        ]
        total += [
            F.sum("_filed").alias("ctrs_filed"),
            F.sum("_unreported").alias("ctrs_unreported"),
            F.sum("_above").alias("txns_above_threshold"),
        ]
    # One row per order and supplier first. The join has already placed the
    # lines by order, so this needs no shuffle of its own, and the orders of a
    # month are then counted without a distinct.
    return (
        facts.groupBy("l_orderkey", "l_suppkey", "_month")
        .agg(*per_order)
        .groupBy("l_suppkey", "_month")
        .agg(*total)
        .join(names, "l_suppkey")
        .withColumn("month", month_label(F.col("_month")))
        .select("bank_name", "branch", "month", *measures)
    )


def str_filing(
    spark: SparkSession,
    sf_dir: str,
    bank_name: str | None = None,
    branch: str | None = None,
    months: list[str] | None = None,
) -> DataFrame:
    """Orders filed, mean days from order to shipment, and shipments later than the limit."""
    return _line_kpis(spark, sf_dir, _STR_COLUMNS, _STR_MEASURES, bank_name, branch, months)


def ctr_reporting(
    spark: SparkSession,
    sf_dir: str,
    bank_name: str | None = None,
    branch: str | None = None,
    months: list[str] | None = None,
) -> DataFrame:
    """Lines filed, lines returned, and lines above the amount."""
    return _line_kpis(spark, sf_dir, _CTR_COLUMNS, _CTR_MEASURES, bank_name, branch, months)


def kyc_edd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders closed and open, and customers in debt, per nation, segment and month."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        "o_orderstatus",
        month_number(F.col("o_orderdate")).alias("_month"),
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("branch")
    )
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("bank_name")
    )
    # One row per customer and month before the join: a customer with very many orders is one row.
    per_customer = orders.groupBy("c_custkey", "_month").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("_done"),
        F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("_open"),
    )
    return (
        per_customer.join(customers, "c_custkey")
        .groupBy("c_nationkey", "branch", "_month")
        .agg(
            F.sum("_done").alias("edd_completed"),
            F.sum("_open").alias("edd_pending"),
            F.count_if(F.col("c_acctbal") < 0).alias("high_risk_customers"),
        )
        .join(nation, "c_nationkey")
        .withColumn("month", month_label(F.col("_month")))
        .select(
            "bank_name", "branch", "month", "edd_completed", "edd_pending", "high_risk_customers"
        )
    )


def _group_names(events: DataFrame) -> DataFrame:
    """bank_name and branch from the user group."""
    return events.withColumns(
        {
            "bank_name": F.concat(F.lit("bank_"), (F.col("_group") % 5).cast("string")),
            "branch": F.concat(F.lit("branch_"), F.col("_group").cast("string")),
            "month": month_label(F.col("_month")),
        }
    )


def sanctions_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, error events, and events above the value, per user group and month."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    grouped = events.groupBy(
        (F.col("user_id") % 25).alias("_group"), month_number(F.col("ts")).alias("_month")
    ).agg(
        F.count(F.lit(1)).alias("transactions_screened"),
        F.count_if(F.col("event_type") == "error").alias("sanctions_hits_flagged"),
        F.count_if(F.col("value") > SCREENING_VALUE).alias("sla_breaches"),
    )
    return _group_names(grouped).select(
        "bank_name", "branch", "month", "transactions_screened", "sanctions_hits_flagged", "sla_breaches"
    )


def training_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, and users with a high-value sign-up, per user group and quarter."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    trained = (F.col("event_type") == "signup") & (F.col("value") > TRAINING_VALUE)
    # One row per user and quarter first; the counts then need no distinct.
    # The first month of the quarter stands for it.
    first_month = F.year("ts") * 100 + F.quarter("ts") * 3 - 2
    users = events.groupBy("user_id", first_month.alias("_month")).agg(
        F.bool_or(F.coalesce(trained, F.lit(False))).alias("_trained")
    )
    grouped = users.groupBy((F.col("user_id") % 25).alias("_group"), "_month").agg(
        F.count(F.lit(1)).alias("staff_total"),
        F.count_if("_trained").alias("staff_trained_aml_cft"),
    )
    return _group_names(grouped).select(
        "bank_name",
        "branch",
        quarter_of_month(F.col("month")).alias("quarter"),
        "staff_total",
        "staff_trained_aml_cft",
    )


def monthly_tables(spark: SparkSession, sf_dir: str, stored: bool = False) -> dict[str, DataFrame]:
    """The four monthly tables. Both line tables select from one pass over the lines, written first if ``stored``."""
    lines = line_kpis(spark, sf_dir)
    if stored:
        lines = materialise(lines, "line-kpis")
    keys = ["bank_name", "branch", "month"]
    return {
        "str_filing_kpi": lines.select(*keys, *_STR_MEASURES),
        "ctr_reporting_kpi": lines.select(*keys, *_CTR_MEASURES),
        "kyc_edd_kpi": kyc_edd(spark, sf_dir),
        "sanctions_screening_kpi": sanctions_screening(spark, sf_dir),
    }


def kpi_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All five KPI tables, for readers that scan them together."""
    return monthly_tables(spark, sf_dir, True) | {"training_compliance_kpi": training_compliance(spark, sf_dir)}


def line_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of both line tables."""
    return _line_kpis(
        spark, sf_dir, _STR_COLUMNS + _CTR_COLUMNS, _STR_MEASURES + _CTR_MEASURES, None, None, None
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, source_file, file_type, text)."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("source_file"), F.col("lang").alias("file_type"), "text"
    )
    return spread(documents, "doc_id")


# The generated prose has none of the domain's words. These replacements put
# them in, by plain substitution, so that the fixed rules meet real hits.
CORPUS_VOCABULARY = (
    ("License", "cash transaction report; each branch shall prepare and submit to bfiu"),
    (" ndly ", " Suspicious Transaction report to the BFIU "),
    (" heed ", " know your customer "),
    (" shanin ", " anti money laundering "),
    (" thend ", " 3 of 40 /g12 "),
)
QUESTION_VOCABULARY = (
    (" was ", " ctr rule "),
    (" are ", " suspicious transaction policy "),
    (" with ", " kyc compare "),
    (" for ", " aml how many "),
)


# Words that make turns into metric questions with a bank, a branch or a period.
METRIC_VOCABULARY = (
    (" was ", " ctr filed in NATION_15, 1996-Q2? "),
    (" are ", " suspicious transaction reports of Supplier#000000003 "),
    (" with ", " kyc at NATION_3 in 1995-07. "),
    (" for ", " sanctions screening of bank_2 "),
    (" from ", " staff training below 95% at branch_7 "),
    (" by ", " count of everything in 1997-02 "),
)


def substitute(col: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def domain_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("text", substitute(F.col("text"), CORPUS_VOCABULARY))


def domain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain corpus in chunks of at most 500 words."""
    return chunk_fixed(domain_corpus(spark, sf_dir))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of the domain corpus, written once: what answers are made from."""
    return materialise(domain_chunks(spark, sf_dir), "document-chunks")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with the domain's words put in."""
    return table(spark, sf_dir, "conversations").withColumn(
        "text", substitute(F.col("text"), QUESTION_VOCABULARY)
    )


def metric_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, question): all turns with metric questions put in."""
    turns = table(spark, sf_dir, "conversations")
    turn_id = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return turns.select(turn_id.alias("turn_id"), substitute(F.col("text"), METRIC_VOCABULARY).alias("question"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, question): the last turn of every conversation."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("question")
    )
    return last.withColumn("question", substitute(F.col("question"), QUESTION_VOCABULARY))


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding): the vectors whose number is a document's. Texts are not touched."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")


def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the vector of the same number; the vector may be missing."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return questions(spark, sf_dir).join(vectors, "conv_id", "left")


def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: (query_id, text, embedding)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(vectors, "query_id")


def csv_folder(tables: dict[str, DataFrame], folder: str) -> None:
    """Stand-in for a folder of CSV files: each table as one file with a header, under the given file name.

    One task writes a file, but only what comes out: the table is made by all tasks.
    """
    for name, df in tables.items():
        spark, draft = df.sparkSession, f"{folder}/_{name}"
        df.repartition(1).write.option("header", True).csv(draft)
        files = spark._jvm.org.apache.hadoop.fs
        place = files.Path(draft)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in store.listStatus(place) if f.getPath().getName().startswith("part-"))
        store.rename(part, files.Path(f"{folder}/{name}"))
        store.delete(place, True)


def high_risk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_nationkey, month, c_custkey): orders of customers in debt."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), month_number(F.col("o_orderdate")).alias("_month"))
    return orders.distinct().join(customers, "c_custkey").select("c_nationkey", month_label(F.col("_month")).alias("month"), "c_custkey")


def revised(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of the sources whose name ends in 3, with new texts and without the toxic ones."""
    toxic = labels.where("toxic = 1").select("doc_id")
    some = documents.where(F.col("source_file").endswith("3")).join(toxic, "doc_id", "left_anti")
    return some.withColumn("text", F.concat(F.lit("Revised. "), F.col("text")))
