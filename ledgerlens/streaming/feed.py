"""Following the feed of a chunk table: an index that processes each commit once, with an offset of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.chunk_table import BEFORE, DELETE, ChunkTable


def sync_index(table: ChunkTable, target: str, checkpoint: str, per_batch: int | None = None) -> None:
    """Apply the commits that ``target`` has not seen, then stop.

    The stream reads the table's manifests, a small file per commit, and keeps
    in ``checkpoint`` which it has seen; the changes of a commit are read when
    it is applied. Several indexes follow one table, each with a checkpoint of
    its own. A batch appends one folder, which it replaces if it is run again
    after a failure. Commits that come late or twice change nothing: the
    highest version of a chunk counts.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        # A row per commit of the batch.
        for row in batch.select("version").distinct().orderBy("version").collect():
            changes = table.changes(row["version"]).where(F.col("change") != BEFORE)
            entry = changes.withColumn("deleted", F.col("change") == DELETE).drop("change")
            entry.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}/commit={row['version']}")

    reader = table.spark.readStream.schema(f"load bigint, `{table.source}` string, version bigint")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    query = (
        reader.option("basePath", f"{table.path}/manifest").parquet(f"{table.path}/manifest")
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_index(spark: SparkSession, target: str, key: str = "id") -> DataFrame:
    """The newest entry of every chunk that is not deleted, with the version that wrote it.

    Which entry counts is found on keys and versions; contents are read by a
    semi-join with what was found.
    """
    entries = spark.read.parquet(target).drop("commit")
    newest = entries.groupBy(key).agg(F.max(F.struct("version", "batch_id", "deleted")).alias("_v")).select(key, "_v.*")
    live = newest.where(~F.col("deleted")).select(key, "version", "batch_id")
    return entries.join(live, [key, "version", "batch_id"], "left_semi").drop("deleted", "batch_id")


def replayed(table: ChunkTable, upto: int | None = None) -> DataFrame:
    """The table's rows made from its feed alone: commits in order, the last image of each chunk."""
    last = table.version() if upto is None else upto
    rows = None
    for number in range(1, last + 1):
        one = table.changes(number).where(F.col("change") != BEFORE)
        rows = one if rows is None else rows.unionByName(one)
    image = F.struct("version", "change", *table.schema.names)
    newest = rows.groupBy(table.key).agg(F.max_by(image, "version").alias("_row"))
    return newest.where(F.col("_row.change") != DELETE).select(*[F.col(f"_row.{c}") for c in table.schema.names])
