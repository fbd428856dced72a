"""Combining ranked lists."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import top_per_group

# Fixed value: the usual smoothing constant of reciprocal rank fusion (Cormack et al. 2009).
RRF_CONSTANT = 60


def reciprocal_rank_fusion(
    lists: list[DataFrame], k: int = 5, query_key: str = "query_id", corpus_key: str = "doc_id"
) -> DataFrame:
    """The ``k`` best rows per query by the sum of 1 / (60 + rank) over the lists.

    The lists hold at most their own k rows per query; they are stacked and
    summed rather than outer-joined.
    """
    stacked = functools.reduce(
        DataFrame.unionByName, [ranked.select(query_key, corpus_key, "rank") for ranked in lists]
    )
    fused = stacked.groupBy(query_key, corpus_key).agg(
        F.round(F.sum(1.0 / (RRF_CONSTANT + F.col("rank"))), 6).alias("score"),
        F.count(F.lit(1)).alias("lists"),
    )
    return top_per_group(fused, query_key, [F.desc("score"), F.asc(corpus_key)], k)


def concat_retrieval(vector_hits: DataFrame, keyword_hits: DataFrame, *columns: str) -> DataFrame:
    """Vector hits, then keyword hits; nothing is removed or ranked again."""
    return (
        vector_hits.select(*columns, "rank")
        .withColumn("section", F.lit("vector"))
        .unionByName(
            keyword_hits.select(*columns, "rank").withColumn("section", F.lit("keyword"))
        )
    )
