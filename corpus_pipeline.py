"""From documents to packed training windows: quality, lines, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.line_dedup import frequent_line_dedup
from ledgerlens.llm.packing import pack_documents
from ledgerlens.llm.quality import fit_quality, judge_quality
from ledgerlens.llm.queries import tokenizer_path
from ledgerlens.llm.simhash import MAX_BITS, simhash_components
from ledgerlens.llm.suffix_dedup import suffix_dedup
from ledgerlens.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep; the forest learns from ``labels``."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, model, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more of the remaining documents share."""
    kept = frequent_line_dedup(docs, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of four-word shingles, linked at four bits or fewer.

    The one with the smallest id stays; of rows that repeat an id, the one
    with the smallest hash of its text, and of rows that are alike, one. Rows
    without an id are documents too, behind all ids. Texts without words are
    near copies of each other.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_hash"))
    named = docs.select(*COLUMNS, key.alias("_key"))
    groups = simhash_components(named, MAX_BITS, id_col="_key")
    stay = groups.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    least = F.min(F.struct(*COLUMNS)).alias("_row")
    return named.join(stay, "_key", "left_semi").groupBy("_key").agg(least).select("_row.*")


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 200 or more that occur elsewhere as well; broken characters at cuts go too."""
    kept = suffix_dedup(docs, carry=("lang", "source"), decoded=True).withColumnRenamed("kept", "text")
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of 2,048."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", repeat_stage),
    ("packing", packing_stage),
]

# Fingerprints, a forest and a tokenizer are beyond SQL: tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
