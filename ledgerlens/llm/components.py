"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node of its component for every node that has an edge.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): large
    and small stars in turns until nothing changes, a logarithmic number of
    rounds. Minima are summed before the shuffle and the joins back may be
    split on a hot node. Each round is a written table, so plans stay short
    and no round is lost with an executor. Nodes are numbers; self-links and
    repeated links are ignored.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    now, path = scratch.save(now)
    state = _state(now)
    while state[0]:
        after, next_path = scratch.save(_small_star(_large_star(now)))
        scratch.drop(path)
        now, path = after, next_path
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number and order-free 128-bit digest of the edges."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))
        ).first()
    )
