"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Runtime settings the plans count on. A key that holds a large part of a join's
# rows is split even where that costs one more shuffle. What a task reads of a
# shuffle is bounded, and with it what it sorts and groups in memory: shuffles are
# cut fine, and adjacent parts are read together up to 16 MB. Whatever the session's
# own number of partitions is, more input gives more tasks, not larger ones, up to
# 16 GB a shuffle; beyond that raise the number of parts. A Python worker is given
# at most 8 MB of rows at a time, however long their texts are.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to any session, local or cluster."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """A local session for tests and the benchmark.

    On a cluster, pass your own session through :func:`tune`.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_root(spark: SparkSession) -> str:
    """The shared folder for written tables and stream checkpoints.

    Clusters name it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder: on a cluster such a folder would exist on one
    machine only and vanish with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


# Paths handed out and not yet dropped, per session; their contents are intermediate.
_MADE: dict[int, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(id(spark), []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Remove what :func:`new_path` handed out in this session; the number of folders that were there.

    Frames that were returned may still read them: call it when results are
    stored, at the end of a run.
    """
    files, removed = spark._jvm.org.apache.hadoop.fs, 0
    for path in _MADE.pop(id(spark), []):
        place = files.Path(path)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        removed += bool(store.exists(place) and store.delete(place, True))
    return removed


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    For results that several branches of a plan need: it is computed once,
    losing an executor does not lose it, and Spark knows its size.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
