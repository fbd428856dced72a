"""The chunk table: writing, refreshing, reading and looking at it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schemas import CHUNKS


def with_chunk_id(chunks: DataFrame, *keys: str) -> DataFrame:
    """Add a deterministic ``id`` so that loading the same documents twice gives the same ids.

    It is the key of an index, so it has 128 bits: a hundred billion chunks
    would share some 64-bit numbers. Lengths keep neighbouring keys apart.
    """
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in (*keys, "chunk_ord")]
    sized = [x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)]
    return chunks.withColumn("id", F.left(F.sha2(F.concat(*sized), 256), F.lit(32)))


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """One write for the whole corpus. ``append`` adds; ``overwrite`` is a full reload.

    No repartitioning: the layout follows the scan, so a source holding most
    of the rows is written by many tasks.
    """
    chunks.select(*CHUNKS.names).write.mode(mode).parquet(path)


def reset_table(spark: SparkSession, path: str) -> None:
    """Create the chunk table if it is absent, else empty it."""
    spark.createDataFrame([], CHUNKS).write.mode("overwrite").parquet(path)


def scan_chunks(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    chunks = spark.read.schema(CHUNKS).parquet(path)
    return chunks.select(*columns) if columns else chunks


def chunk_preview(chunks: DataFrame, newest_first: list[str], rows: int = 20) -> DataFrame:
    """The newest chunks with their first 100 characters and their length."""
    return (
        chunks.orderBy(*[F.desc(c) for c in newest_first])
        .limit(rows)
        .select(
            *newest_first,
            "file_type",
            "source_file",
            F.left("chunk_text", F.lit(100)).alias("chunk_preview"),
            F.length("chunk_text").cast("bigint").alias("chunk_length"),
        )
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count, file count and chunk lengths per file type."""
    size = F.length("chunk_text").cast("bigint")
    return (
        chunks.groupBy("file_type")
        .agg(
            F.count(F.lit(1)).alias("total_chunks"),
            F.count_distinct("source_file").alias("file_count"),
            F.round(F.avg(size), 6).alias("avg_chunk_length"),
            F.min(size).alias("min_chunk_length"),
            F.max(size).alias("max_chunk_length"),
        )
        .orderBy("file_type")
    )


def ingest_summary(files: DataFrame, chunks: DataFrame, *file_key: str) -> DataFrame:
    """Per file type: files listed, files that gave chunks, and chunks.

    Chunks are counted per file before the join, and the join keeps files
    without any chunk: those count as failed.
    """
    per_file = chunks.groupBy(*file_key).agg(F.count(F.lit(1)).alias("_chunks"))
    found = F.coalesce("_chunks", F.lit(0))
    return (
        files.select(*file_key, "file_type")
        .join(per_file, list(file_key), "left")
        .groupBy("file_type")
        .agg(
            F.count(F.lit(1)).alias("files_total"),
            F.count_if(found > 0).alias("files_processed"),
            F.sum(found).alias("chunks_stored"),
        )
    )
