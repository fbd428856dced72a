"""Triggered sync, keyed upsert and snapshot comparison.

Both streams run with ``availableNow``: they process what is new and stop.
Their state is the stream checkpoint, so a lost executor or a restarted
driver continues without reading a file twice or writing a batch twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.text import clean_text
from ledgerlens.operators.chunking import MAX_TOKENS, chunk_fixed


def _source(
    spark: SparkSession, directory: str, schema: StructType, files: str, per_batch: int | None
) -> DataFrame:
    # As a pattern that only it matches: the table may then be a folder or a single file.
    place = directory.rstrip("/")
    directory = f"{place[:-1]}[{place[-1]}]"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(directory)


def sync_chunks(
    spark: SparkSession,
    directory: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    key: str = "doc_id",
    files: str = "*.parquet",
    max_tokens: int = MAX_TOKENS,
    per_batch: int | None = None,
) -> None:
    """Chunk and clean the documents of files not seen before, then stop.

    A batch writes one folder of its own; run again after a failure, it
    replaces that folder.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_fixed(batch, max_tokens=max_tokens).withColumn(
            "chunk_text", clean_text(F.col("chunk_text"))
        )
        chunks.where(F.col("chunk_text") != "").write.mode("overwrite").parquet(
            f"{target}/batch_id={batch_id}"
        )

    query = (
        _source(spark, directory, schema, files, per_batch)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def upsert_chunks(
    spark: SparkSession,
    directory: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    key: str = "doc_id",
    files: str = "*.parquet",
    max_tokens: int = MAX_TOKENS,
    per_batch: int | None = None,
) -> None:
    """Append every batch's document versions and their chunks.

    Input rows carry ``key``, ``text``, ``version`` and ``deleted``. Nothing
    is rewritten: a batch adds one folder of chunks and one of versions, and
    :func:`current_chunks` keeps the newest version of each document. A batch
    that is run again after a failure replaces its own folders only. So a
    source that holds most documents costs no more than its changed ones.

    Of several rows of one document in a batch the highest version counts; of
    one version, a deletion before a text, then the text with the larger hash.
    The choice is made once, on narrow columns, and written; chunks are made
    of the rows it names.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        chosen = F.struct("version", "deleted", F.xxhash64("text").alias("text_hash"))
        newest = batch.groupBy(key).agg(F.max(chosen).alias("_row")).select(key, "_row.*")
        versions = f"{target}/versions/batch_id={batch_id}"
        newest.write.mode("overwrite").parquet(versions)
        live = spark.read.schema(newest.schema).parquet(versions).where(~F.col("deleted"))
        rows = batch.withColumn("text_hash", F.xxhash64("text")).join(
            live.select(key, "version", "text_hash"), [key, "version", "text_hash"], "left_semi"
        )
        # Rows that are repeated whole are one.
        rows = rows.where(~F.col("deleted")).drop("deleted", "text_hash").dropDuplicates([key])
        chunk_fixed(rows, max_tokens=max_tokens).write.mode("overwrite").parquet(
            f"{target}/chunks/batch_id={batch_id}"
        )

    query = (
        _source(spark, directory, schema, files, per_batch)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _newest(spark: SparkSession, target: str, key: str) -> DataFrame:
    return (
        spark.read.parquet(f"{target}/versions")
        .groupBy(key)
        .agg(F.max(F.struct("version", "batch_id", "deleted")).alias("_v"))
        .select(key, "_v.*")
    )


def current_chunks(spark: SparkSession, target: str, key: str = "doc_id") -> DataFrame:
    """Chunks of the newest version of each document that is not deleted."""
    newest = _newest(spark, target, key).where(~F.col("deleted")).select(key, "version", "batch_id")
    chunks = spark.read.parquet(f"{target}/chunks")
    return chunks.join(newest, [key, "version", "batch_id"], "left_semi").drop("batch_id")


def compact(spark: SparkSession, target: str, compacted: str, key: str = "doc_id") -> None:
    """Write only what is current to a new folder, in the same layout.

    Deletions stay as versions, so that an older row that comes late is still
    known to be older. Point readers and the stream to the new folder, then
    remove the old one; batches go on under their own numbers.
    """
    newest = _newest(spark, target, key)
    chunks = spark.read.parquet(f"{target}/chunks").join(
        newest.where(~F.col("deleted")).select(key, "version", "batch_id"), [key, "version", "batch_id"], "left_semi"
    )
    newest.write.partitionBy("batch_id").parquet(f"{compacted}/versions")
    chunks.write.partitionBy("batch_id").parquet(f"{compacted}/chunks")


def changed_documents(
    before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, status): new, changed, removed or unchanged between two snapshots.

    Each side is reduced to a hash before the join, so texts are not shuffled.
    """
    old = before.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_old"))
    new = after.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
        .otherwise("unchanged")
    )
    return old.join(new, key, "full_outer").select(key, status.alias("status"))
