"""Documents to a chunk table, CSV files to KPI tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.chunking import MAX_TOKENS, chunk_fixed
from ledgerlens.schemas import KPI_TABLES
from ledgerlens.sources.chunk_store import scan_chunks, with_chunk_id, write_chunks
from ledgerlens.sources.csv_folder import load_csv_folder
from ledgerlens.sources.files import Loaded, load_csv


def ingest_documents(
    spark: SparkSession,
    documents: DataFrame,
    target: str,
    mode: str = "overwrite",
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Chunk (doc_id, source_file, file_type, text) into the chunk table and read it back.

    One scan and one write for the whole corpus; a document without words
    gives no rows and stops nothing.
    """
    chunks = with_chunk_id(chunk_fixed(documents, max_tokens=max_tokens), "source_file", "doc_id")
    write_chunks(chunks, target, mode)
    return scan_chunks(spark, target)


def ingest_kpi_csv(spark: SparkSession, csv_path: str, name: str, target: str) -> Loaded:
    """Load one KPI CSV with its declared schema."""
    return load_csv(spark, csv_path, KPI_TABLES[name], target)


def ingest_csv_folder(spark: SparkSession, directory: str, target: str) -> dict[str, Loaded]:
    """Load every CSV of a flat folder as a table; what became of each file, by file name.

    A file that cannot be read does not stop the others. Known tables get
    their declared schema. Of files whose names give the same table, the first
    loads and the others are refused.
    """
    return {name: loaded for name, (_, loaded) in load_csv_folder(spark, directory, target, KPI_TABLES).items()}
