"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import routing, text
from ledgerlens.functions.calendar import months_of_quarter
from ledgerlens.operators import assembly, chunking, fusion, keyword_search, kpi, period_bitmaps, ranking, rule_search
from ledgerlens.operators.hybrid import hybrid_topk
from ledgerlens.operators.inverted_index import index_topk, open_index, write_segment
from ledgerlens.operators.lexical_search import bm25_topk
from ledgerlens.operators.vector_search import vector_topk
from ledgerlens.plans import answer, ingest, metrics, standins
from ledgerlens.schemas import KPI_TABLES
from ledgerlens.plans.standins import spread
from ledgerlens.session import materialise, new_path, tune
from ledgerlens.sources import chunk_store, files, ledger, pages
from ledgerlens.sources.chunk_table import ChunkTable
from ledgerlens.sources.tables import table
from ledgerlens.streaming import feed, snapshots, sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BANK, BRANCH_NAME, MONTH, QUARTER = "NATION_15", "Supplier#000000000", "1996-05", "1996-Q2"
KEYWORD_QUESTION = "Which CTR, suspicious transaction and KYC rules bind a branch?"


def query(run: Query, name: str | None = None) -> Query:
    QUERIES[name or run.__name__] = lambda spark, d: run(tune(spark), d)
    return run


# --- scans, sources, sinks -------------------------------------------------


@query
def s1_discover_files(spark, d):
    return files.discover_files(spark, d, (".parquet",)).select("file_name", "file_type")


@query
def s2_scan_documents(spark, d):
    return pages.document_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query
def s2_chunk_pages(spark, d):
    return pages.chunk_pages(
        table(spark, d, "conversations"), "conv_id", "turn", "text", max_tokens=50
    )


@query
def s3_load_csv(spark, d):
    source, target = new_path(spark, "csv"), new_path(spark, "ctr_reporting_kpi")
    # The header is in another order than the declared columns, and has one more.
    rows = standins.ctr_reporting(spark, d)
    turned = rows.select(*reversed(rows.columns), F.lit("n/a").alias("remark"))
    turned.write.option("header", True).csv(source)
    ingest.ingest_kpi_csv(spark, source, "ctr_reporting_kpi", target)
    return spark.read.schema(KPI_TABLES["ctr_reporting_kpi"]).parquet(target)


@query
def s4_table_name(spark, d):
    name = F.concat("source", F.lit(" "), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".csv"))
    listed = table(spark, d, "documents").select(name.alias("file_name"))
    return files.with_table_names(listed)


_CHUNK = ["source_file", "file_type", "chunk_ord", "chunk_text", "n_tokens"]


@query
def s5_write_chunks(spark, d):
    """With the number of chunks that share an id: one each."""
    target = new_path(spark, "document_chunks")
    chunks = ingest.ingest_documents(spark, standins.corpus(spark, d), target, "append")
    shared = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("id_count"))
    return chunks.join(shared, "id").select(*_CHUNK, "id_count")


@query
def s6_reset_table(spark, d):
    """Loading, resetting and loading again leaves one copy."""
    target = new_path(spark, "document_chunks")
    documents = standins.corpus(spark, d)
    ingest.ingest_documents(spark, documents, target, "append", 100)
    chunk_store.reset_table(spark, target)
    return ingest.ingest_documents(spark, documents, target, "append", 100).select(*_CHUNK)


def _chunks_of(documents, max_tokens=100):
    return chunk_store.with_chunk_id(chunking.chunk_fixed(documents, max_tokens=max_tokens), "source_file", "doc_id")


def _refreshed(spark, d):
    """A chunk table with all documents, some of whose sources were loaded again."""
    documents = standins.corpus(spark, d)
    chunks = ChunkTable(spark, new_path(spark, "chunk-table"))
    chunks.commit(_chunks_of(documents))
    again = documents.where(F.col("source_file").endswith("3")).select("source_file")
    chunks.commit(_chunks_of(standins.revised(documents, table(spark, d, "labels"))), again)
    return chunks


@query
def s6_partial_refresh(spark, d):
    return _refreshed(spark, d).scan().select(*_CHUNK)


@query
def s7_scan_chunks(spark, d):
    target = new_path(spark, "document_chunks")
    ingest.ingest_documents(spark, standins.domain_corpus(spark, d), target)
    return chunk_store.scan_chunks(spark, target, "source_file", "chunk_ord", "n_tokens")


@query
def s8_ingest_summary(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("").alias("_blank"))
    documents = (
        standins.corpus(spark, d)
        .join(toxic, "doc_id", "left")
        .withColumn("text", F.coalesce("_blank", "text"))
        .drop("_blank")
    )
    return chunk_store.ingest_summary(documents, chunking.chunk_fixed(documents), "doc_id")


@query
def s8_ingest_ledger(spark, d):
    """Chunks of all sources, some of which are blank, and a folder of CSV files, one of which clashes with another."""
    target, folder = new_path(spark, "ingested"), new_path(spark, "csv-folder")
    blank = F.when(~F.col("source_file").endswith("3"), F.col("text")).otherwise("")
    ledger.ingest_chunks(standins.corpus(spark, d).withColumn("text", blank), target, "first")
    kpis = standins.kpi_tables(spark, d)
    names = {f"{name}.csv": df for name, df in kpis.items()} | {"kyc-edd kpi.csv": kpis["kyc_edd_kpi"]}
    standins.csv_folder(names, folder)
    ledger.ingest_tables(spark, folder, target, "first")
    return ledger.read_ledger(spark, target).drop("error")


# --- chunking and text preparation -----------------------------------------


def _doubled(spark, d):
    """Documents with every line break doubled, as the prose has no blank lines."""
    return standins.corpus(spark, d).select(
        "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")
    )


@query
def c1_chunk_fixed(spark, d):
    return chunking.chunk_fixed(standins.corpus(spark, d))


@query
def c2_chunk_greedy(spark, d):
    return chunking.chunk_greedy(_doubled(spark, d), max_tokens=60)


@query
def c2_chunk_progressive(spark, d):
    return chunking.chunk_greedy(
        _doubled(spark, d), max_tokens=60, separators=("\n\n",), hard_split=False
    )


@query
def c2_chunk_all_separators(spark, d):
    return chunking.chunk_greedy(_doubled(spark, d), max_tokens=60, hard_split=False)


def _row_texts(spark, d):
    days = F.col("avg_str_filing_days").cast("decimal(18,2)")
    rows = standins.str_filing(spark, d).withColumn("avg_str_filing_days", days)
    return rows.select(
        "bank_name",
        "branch",
        "month",
        chunking.rows_to_text(rows, "str_filing_kpi.csv").alias("row_text"),
    )


@query
def c3_rows_to_text(spark, d):
    return _row_texts(spark, d)


@query
def c3_row_chunks(spark, d):
    return chunking.chunk_fixed(_row_texts(spark, d), "row_text", max_tokens=8)


@query
def c4_clean_text(spark, d):
    noisy = F.concat(
        F.lit("<s>"),
        F.replace("text", F.lit(" of "), F.lit(" 3 of 40 /g12 ")),
        F.lit(" </s>  "),
    )
    return standins.corpus(spark, d).select("doc_id", text.clean_text(noisy).alias("clean_text"))


@query
def c5_token_count(spark, d):
    return standins.corpus(spark, d).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query
def c6_chunk_preview(spark, d):
    chunks = chunking.chunk_fixed(standins.corpus(spark, d))
    return chunk_store.chunk_preview(chunks, ["doc_id", "chunk_ord"])


@query
def c7_corpus_stats(spark, d):
    return chunk_store.corpus_stats(chunking.chunk_fixed(standins.corpus(spark, d)))


# --- projections, filters, predicates --------------------------------------


@query
def f1_equality_conjunction(spark, d):
    wanted = kpi.equal_to(l_returnflag="R", l_linestatus="F")
    return table(spark, d, "lineitem").where(wanted).select("l_orderkey", "l_linenumber", "l_quantity")


@query
def f2_in_quarter(spark, d):
    ctr = standins.ctr_reporting(spark, d, months=months_of_quarter(QUARTER))
    return ctr.where(kpi.in_quarter("month", QUARTER))


@query
def f3_case_folded_like(spark, d):
    wanted = kpi.folded(F.col("text"), lambda low: kpi.holds_in_order(low, "%the%license%"))
    return standins.corpus(spark, d).where(wanted).select("doc_id", "source_file")


# Per topic the pattern that must match, and those of which one must.
TOPIC_PATTERNS = (
    ("%cash transaction%", ("%branch%prepare%", "%monthly%ctr%")),
    ("%suspicious transaction%", ("%report%bfiu%", "%submit%sar%")),
    ("%know your customer%",),
)


@query
def f4_topic_predicates(spark, d):
    wanted = kpi.folded(
        F.col("text"),
        lambda low: kpi.any_topic([kpi.topic_matches(low, *patterns) for patterns in TOPIC_PATTERNS]),
    )
    return standins.domain_corpus(spark, d).where(wanted).select("doc_id", "source_file")


@query
def f5_ratio_threshold(spark, d):
    rates = kpi.edd_completion_rate(standins.kyc_edd(spark, d))
    return rates.where(F.col("completion_rate") < 0.34).select("bank_name", "completion_rate")


@query
def f6_projection(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net_price"),
    )


@query
def f7_excerpt(spark, d):
    return standins.corpus(spark, d).select(
        "doc_id", text.excerpt(text.clean_text(F.col("text"))).alias("excerpt")
    )


@query
def f8_null_rendering(spark, d):
    days = F.col("avg_str_filing_days").cast("decimal(18,2)")
    return standins.str_filing(spark, d).select(
        "bank_name", "branch", "month", text.shown(days).alias("avg_days")
    )


# --- KPI queries ------------------------------------------------------------


@query
def k1_branch_breaches(spark, d):
    kpis = standins.str_filing(spark, d, BANK, BRANCH_NAME, [MONTH])
    return kpi.branch_month_detail(kpis, BANK, BRANCH_NAME, MONTH).withColumn(
        "avg_str_filing_days", F.round("avg_str_filing_days", 6)
    )


@query
def k2_most_unreported_ctrs(spark, d):
    ctr = standins.ctr_reporting(spark, d, months=months_of_quarter(QUARTER))
    return kpi.most_unreported_ctrs(ctr, QUARTER)


@query
def k3_edd_completion_rate(spark, d):
    return kpi.edd_completion_rate(standins.kyc_edd(spark, d))


@query
def k4_most_str_breaches(spark, d):
    return kpi.most_str_breaches(standins.str_filing(spark, d))


@query
def k5_branch_quarter_ctrs(spark, d):
    ctr = standins.ctr_reporting(spark, d, branch=BRANCH_NAME, months=months_of_quarter(QUARTER))
    return kpi.branch_quarter_detail(ctr, BRANCH_NAME, QUARTER)


@query
def k6_training_below(spark, d):
    return kpi.training_below(standins.training_compliance(spark, d))


@query
def k7_ctr_filing_rate(spark, d):
    return kpi.ctr_filing_rate(standins.ctr_reporting(spark, d))


@query
def k8_sanctions_rates(spark, d):
    return kpi.sanctions_rates(standins.sanctions_screening(spark, d))


@query
def k9_str_timeliness(spark, d):
    return kpi.str_timeliness(standins.str_filing(spark, d))


@query
def k10_high_risk_customers(spark, d):
    return kpi.high_risk_customers(standins.kyc_edd(spark, d))


@query
def k10_customers_by_period(spark, d):
    """From stored months, one of which is loaded again."""
    path, group = new_path(spark, "months"), ("c_nationkey",)
    bitmaps = period_bitmaps.month_bitmaps(standins.high_risk_orders(spark, d), group, "month", "c_custkey")
    period_bitmaps.write_months(bitmaps, path)
    period_bitmaps.write_months(bitmaps.where(F.col("month") == MONTH), path)
    counts = period_bitmaps.customers_by_period(period_bitmaps.stored_months(spark, path, bitmaps.schema), group)
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("bank_name"))
    return counts.join(nation, "c_nationkey").select("bank_name", "period", "customers")


@query
def k11_quarterly_volumes(spark, d):
    return kpi.quarterly_volumes(standins.str_filing(spark, d))


@query
def k12_gap_flags(spark, d):
    ctr = standins.ctr_reporting(spark, d)
    return kpi.gap_flag(ctr, "ctrs_unreported").select(
        "bank_name", "branch", "month", "ctrs_unreported", "gap"
    )


@query
def k13_compliance_gaps(spark, d):
    return kpi.compliance_gaps(standins.monthly_tables(spark, d))


# --- retrieval, ranking, top-k ---------------------------------------------


@query
def v1_vector_topk(spark, d):
    """Benchmark items against every vector."""
    vectors = table(spark, d, "embeddings")
    hits = vector_topk(standins.embedded_items(spark, d), vectors, corpus_key="vec_id")
    return hits.join(vectors.select("vec_id", "label"), "vec_id").withColumn(
        "label", F.col("label").cast("bigint")
    )


def _domain_chunks(spark, d):
    return chunking.chunk_fixed(standins.domain_corpus(spark, d), max_tokens=100)


@query
def v2_keyword_search(spark, d):
    return keyword_search.keyword_search(
        _domain_chunks(spark, d), KEYWORD_QUESTION, ["doc_id", "chunk_ord"]
    ).select("doc_id", "chunk_ord", "source_file", "file_type", "chunk_text")


@query
def v3_keyword_batch(spark, d):
    order = ["doc_id", "chunk_ord"]
    hits = keyword_search.first_hits_per_topic(_domain_chunks(spark, d), order)
    return keyword_search.keyword_batch(
        standins.questions(spark, d), hits, order, "conv_id"
    ).select("conv_id", "rank", "doc_id", "chunk_ord", "chunk_text")


@query
def v3_rule_table(spark, d):
    """The same from rules that are a table; the chunks are stored, as they are read three times."""
    chunks = materialise(_domain_chunks(spark, d), "rule-chunks")
    hits = rule_search.rule_batch(
        standins.questions(spark, d), chunks, rule_search.rule_tables(spark), ["doc_id", "chunk_ord"], "conv_id"
    )
    return hits.select("conv_id", "rank", "doc_id", "chunk_ord", "chunk_text")


@query
def v4_bm25_topk(spark, d):
    return bm25_topk(table(spark, d, "benchmark"), standins.corpus(spark, d), query_key="item_id")


@query
def v4_bm25_index(spark, d):
    """From a stored index of two segments: the labelled documents, then the others."""
    path, documents = new_path(spark, "index"), standins.corpus(spark, d)
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    write_segment(documents.join(labelled, "doc_id", "left_semi"), path, 0)
    write_segment(documents.join(labelled, "doc_id", "left_anti"), path, 1)
    return index_topk(table(spark, d, "benchmark"), open_index(spark, path), query_key="item_id")


@query
def v5_hybrid_topk(spark, d):
    return hybrid_topk(
        standins.embedded_items(spark, d), standins.corpus_vectors(spark, d), standins.domain_corpus(spark, d)
    )


def _asked(spark, d):
    return materialise(answer.routed(standins.embedded_questions(spark, d)), "questions")


def _document_hits(spark, d, asked):
    """Only the texts of winners are cut into chunks."""
    texts = standins.domain_corpus(spark, d)
    return answer.document_hits(
        asked, standins.corpus_vectors(spark, d), lambda keys: chunking.chunk_fixed(texts.join(keys, "doc_id", "left_semi"))
    )


@query
def v6_concat_retrieval(spark, d):
    asked, chunks = _asked(spark, d), standins.stored_chunks(spark, d)
    return fusion.concat_retrieval(
        answer.document_hits(asked, standins.corpus_vectors(spark, d), chunks),
        answer.keyword_hits(asked, chunks),
        "conv_id",
        "doc_id",
        "chunk_ord",
        "source_file",
    )


@query
def v7_order_limit(spark, d):
    return (
        table(spark, d, "orders")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(20)
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query
def v8_row_cap(spark, d):
    ctr = standins.ctr_reporting(spark, d)
    order = [F.desc("ctrs_unreported"), F.asc("bank_name"), F.asc("branch"), F.asc("month")]
    return ranking.row_cap(ctr, order)


# --- routing and context assembly -------------------------------------------


@query
def q1_last_question(spark, d):
    return standins.questions(spark, d)


def _flag(name, test):
    def run(spark, d):
        turns = standins.conversation_turns(spark, d)
        return turns.select("conv_id", "turn", test(F.col("text")).alias(name))

    return run


query(_flag("needs_sql", routing.needs_sql), "q2_needs_sql")
query(_flag("needs_docs", routing.needs_docs), "q3_needs_docs")
query(_flag("keyword_gate", routing.keyword_gate), "q4_keyword_gate")


@query
def q5_route(spark, d):
    turns = standins.conversation_turns(spark, d)
    return turns.groupBy(routing.route(F.col("text")).alias("route")).agg(
        F.count(F.lit(1)).alias("turns")
    )


@query
def q6_citation_block(spark, d):
    return assembly.citation_blocks(
        _document_hits(spark, d, _asked(spark, d)), "conv_id", "chunk_text", "place"
    )


@query
def q7_result_block(spark, d):
    ctr = kpi.ctr_filing_rate(standins.ctr_reporting(spark, d))
    return assembly.result_block(ctr, [F.asc("bank_name"), F.asc("branch")], "CTR filing by branch")


@query
def q8_assemble_context(spark, d):
    return answer.answer_questions(
        standins.embedded_questions(spark, d),
        standins.corpus_vectors(spark, d),
        standins.stored_chunks(spark, d),
        standins.kpi_tables(spark, d),
    )


@query
def q8_metric_answers(spark, d):
    return metrics.metric_answers(standins.metric_turns(spark, d), standins.kpi_tables(spark, d), "turn_id")


@query
def q9_cited_sources(spark, d):
    asked = _asked(spark, d)
    return assembly.cited_sources(
        asked.select("conv_id", "route"), _document_hits(spark, d, asked), "conv_id"
    )


@query
def text_strip_sql_fence(spark, d):
    fenced = F.concat(F.lit("```sql\n"), F.col("text"), F.lit("\n```  "))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", text.strip_sql_fence(fenced).alias("statement")
    )


# --- incremental and streaming ----------------------------------------------


@query
def t1_sync_chunks(spark, d):
    target, checkpoint = new_path(spark, "chunks"), new_path(spark, "sync")
    schema = table(spark, d, "documents").schema
    sync.sync_chunks(spark, f"{d}/documents.parquet", schema, target, checkpoint)
    chunks = spark.read.parquet(target)
    return chunks.select("doc_id", "source", "lang", "chunk_ord", "chunk_text")


@query
def t1_change_feed(spark, d):
    """An index that follows a table's feed: all sources, some loaded again, some removed."""
    target, checkpoint = new_path(spark, "chunk-index"), new_path(spark, "feed")
    chunks = _refreshed(spark, d)
    feed.sync_index(chunks, target, checkpoint)
    gone = standins.corpus(spark, d).where(F.col("source_file").endswith("7")).select("source_file")
    chunks.commit(chunks.scan().where("false"), gone)
    feed.sync_index(chunks, target, checkpoint)
    return feed.current_index(spark, target).select(*_CHUNK, "version")


@query
def t2_upsert_chunks(spark, d):
    """All documents, then new texts for the labelled ones, then the toxic ones deleted."""
    feed, target = new_path(spark, "feed"), new_path(spark, "chunks")
    documents = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels")
    versions = [
        documents.withColumn("version", F.lit(1)).withColumn("deleted", F.lit(False)),
        documents.join(labels, "doc_id", "left_semi")
        .withColumn("text", F.concat(F.lit("Revised. "), F.col("text")))
        .withColumn("version", F.lit(2))
        .withColumn("deleted", F.lit(False)),
        documents.join(labels.where("toxic = 1"), "doc_id", "left_semi")
        .withColumn("text", F.lit(None).cast("string"))
        .withColumn("version", F.lit(3))
        .withColumn("deleted", F.lit(True)),
    ]
    checkpoint = new_path(spark, "upsert")
    for version in versions:
        version.write.mode("append").parquet(feed)
        sync.upsert_chunks(spark, feed, versions[0].schema, target, checkpoint)
    return sync.current_chunks(spark, target).select("doc_id", "version", "chunk_ord", "chunk_text")


@query
def t3_changed_documents(spark, d):
    """Labelled documents against the non-toxic ones of all documents, cleaned."""
    documents = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    labels = table(spark, d, "labels")
    before = documents.join(labels, "doc_id", "left_semi")
    after = documents.join(labels.where("toxic = 1"), "doc_id", "left_anti").withColumn(
        "text", text.clean_text(F.col("text"))
    )
    return sync.changed_documents(before, after)


@query
def t3_changed_chunks(spark, d):
    """Chunks of all documents, and of the documents after some sources were loaded again."""
    documents = standins.corpus(spark, d)
    revised = standins.revised(documents, table(spark, d, "labels"))
    after = documents.where(~F.col("source_file").endswith("3")).unionByName(revised)
    paths, keys = [], ("doc_id", "chunk_ord")
    for state in (documents, after):
        paths.append(new_path(spark, "snapshot"))
        snapshots.write_snapshot(chunking.chunk_fixed(state, max_tokens=100), paths[-1], keys, ("chunk_text", "file_type"))
    return snapshots.changed_rows(spark, *paths, keys, ("chunk_text", "file_type"))
