"""The ledger of ingestion: a row per run and file, with what became of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.operators.chunking import MAX_TOKENS, chunk_fixed
from ledgerlens.schemas import KPI_TABLES
from ledgerlens.sources.chunk_store import scan_chunks, with_chunk_id, write_chunks
from ledgerlens.sources.csv_folder import load_csv_folder

LEDGER = (
    "run string, file_name string, file_type string, status string, table_name string, "
    "rows bigint, bad_values bigint, chunks bigint, error string"
)
LOADED, FAILED, EMPTY = "loaded", "failed", "empty"


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    """All runs so far."""
    return spark.read.schema(StructType.fromDDL(LEDGER)).parquet(f"{target}/ledger").drop("sink")


def _record(rows: DataFrame, target: str, run: str, sink: str) -> None:
    """Append a sink's rows to the run; a sink that is run again replaces its own."""
    names = [f.name for f in StructType.fromDDL(LEDGER) if f.name != "run"]
    rows.select(*names).write.mode("overwrite").parquet(f"{target}/ledger/run={run}/sink={sink}")


def ingest_tables(spark: SparkSession, directory: str, target: str, run: str, schemas: dict[str, StructType] = KPI_TABLES) -> None:
    """Load the CSV files of a folder as ``target/tables``, and record each."""
    loaded = load_csv_folder(spark, directory, f"{target}/tables", schemas)
    rows = [
        (name, "CSV", FAILED if x.error else LOADED, None if x.error else table, x.rows, x.bad_values, 0, x.error)
        for name, (table, x) in loaded.items()
    ]
    fields = StructType([f for f in StructType.fromDDL(LEDGER) if f.name != "run"])
    _record(spark.createDataFrame(rows, fields), target, run, "tables")


def ingest_chunks(documents: DataFrame, target: str, run: str, max_tokens: int = MAX_TOKENS) -> tuple[int, int]:
    """Chunk (doc_id, source_file, file_type, text) into ``target/chunks``, and record every source file.

    The write itself counts what goes in and what comes out; the ledger's row
    of a file has what the stored table holds of it. A file whose documents
    give no chunk is empty, not missing. Returns documents read and chunks
    written.
    """
    spark = documents.sparkSession
    read, wrote = Observation(), Observation()
    given = documents.observe(read, F.count(F.lit(1)).alias("n"))
    chunks = with_chunk_id(chunk_fixed(given, max_tokens=max_tokens), "source_file", "doc_id")
    # A run has a folder of its own in the table: run again, it replaces its own chunks only.
    folder = f"{target}/chunks/run={run}"
    write_chunks(chunks.observe(wrote, F.count(F.lit(1)).alias("n")), folder, "overwrite")
    stored = scan_chunks(spark, folder, "source_file", "file_type").groupBy("source_file", "file_type").agg(F.count(F.lit(1)).alias("chunks"))
    listed = documents.select("source_file", "file_type").distinct()
    rows = listed.join(stored, ["source_file", "file_type"], "left").select(
        F.col("source_file").alias("file_name"), "file_type",
        F.when(F.col("chunks") > 0, LOADED).otherwise(EMPTY).alias("status"),
        F.when(F.col("chunks") > 0, "chunks").alias("table_name"),
        F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("bad_values"),
        F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), F.lit(None).cast("string").alias("error"),
    )
    _record(rows, target, run, "chunks")
    return read.get["n"], wrote.get["n"]


def run_summary(ledger: DataFrame) -> DataFrame:
    """(run, file_type, files_listed, files_loaded, files_failed, tables_created, rows, bad_values, chunks_stored)."""
    count = lambda status: F.count_if(F.col("status") == status)
    return ledger.groupBy("run", "file_type").agg(
        F.count(F.lit(1)).alias("files_listed"), count(LOADED).alias("files_loaded"), count(FAILED).alias("files_failed"),
        F.count_distinct("table_name").alias("tables_created"), F.sum("rows").alias("rows"),
        F.sum("bad_values").alias("bad_values"), F.sum("chunks").alias("chunks_stored"),
    )
