"""Snapshots with hash trees, compared without reading what is equal (Merkle 1987).

Rows are dealt to buckets by the hash of their key. A leaf is the digest of a bucket, whatever
the order of its rows; inner nodes are digests of their children. Two snapshots are compared
from the root down, and only buckets whose leaves differ are read.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 16
LEVELS = 2  # below the root: 256 buckets


def _digest(keys: tuple[str, ...], values: tuple[str, ...]) -> list[Column]:
    """Number of rows, and two sums of their hashes: the same for any order, and not for a row twice."""
    row = F.struct(*keys, *values)
    wide = lambda h: F.sum(h.cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("rows"), wide(F.xxhash64(row)).alias("a"), wide(F.xxhash64(F.lit("second"), row)).alias("b")]


def write_snapshot(
    rows: DataFrame, path: str, keys: tuple[str, ...], values: tuple[str, ...], levels: int = LEVELS, fanout: int = FANOUT
) -> None:
    """Write ``rows`` by bucket with their tree; ``keys`` tell a row, ``values`` are what may change."""
    n = fanout**levels
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")
    spark, dealt = rows.sparkSession, rows.select(*keys, *values, bucket)
    dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    # Declared: a snapshot of no rows has no file to infer from.
    spark.createDataFrame([(dealt.schema.json(),)], "fields string").write.parquet(f"{path}/schema")
    written = _rows(spark, path)
    total = F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", "a", "b")])
    node = written.groupBy(F.col("bucket").alias("node")).agg(*_digest(keys, values)).select(
        F.lit(levels).alias("level"), "node", F.sha2(total, 256).alias("digest")
    )
    tree = [node]
    for level in range(levels - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["digest"])), ",")
        node = node.groupBy(F.floor(F.col("node") / fanout).cast("int").alias("node")).agg(F.sha2(children, 256).alias("digest")).select(
            F.lit(level).alias("level"), "node", "digest"
        )
        tree.append(node)
    # One row per node: a seventeenth more than there are buckets.
    functools.reduce(DataFrame.unionByName, tree).coalesce(1).write.parquet(f"{path}/tree")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    fields = spark.read.parquet(f"{path}/schema").first()[0]
    return spark.read.schema(StructType.fromJson(json.loads(fields))).parquet(f"{path}/rows")


def differing_buckets(spark: SparkSession, before: str, after: str, levels: int = LEVELS, fanout: int = FANOUT) -> list[int]:
    """Buckets whose rows are not the same in both snapshots; equal parts of the trees are not looked at."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (before, after)]
    open_: list[int] | None = None
    for level in range(levels + 1):
        old, new = (
            t.where(F.col("level") == level).where(F.lit(True) if open_ is None else F.floor(F.col("node") / fanout).isin(open_))
            .select("node", F.col("digest").alias(name))
            for t, name in zip(trees, ("_old", "_new"))
        )
        differ = old.join(new, "node", "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
        # At most as many as there are buckets, a parameter.
        open_ = sorted(r[0] for r in differ.select("node").collect())
        if not open_:
            break
    return open_


def changed_rows(
    spark: SparkSession,
    before: str,
    after: str,
    keys: tuple[str, ...],
    values: tuple[str, ...],
    levels: int = LEVELS,
    fanout: int = FANOUT,
) -> DataFrame:
    """(keys, status): rows that are new, changed or removed between two written snapshots.

    Keys are unique and present. Rows without a status are the same in both.
    Only the folders of buckets that differ are read, and of their rows only
    hashes are joined.
    """
    buckets = differing_buckets(spark, before, after, levels, fanout)
    sides = []
    for path, name in ((before, "_old"), (after, "_new")):
        rows = _rows(spark, path).where(F.col("bucket").isin(buckets))
        sides.append(rows.select("bucket", *keys, F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256).alias(name)))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    joined = sides[0].join(sides[1], ["bucket", *keys], "full_outer")
    return joined.select(*keys, status.alias("status")).where("status IS NOT NULL")
