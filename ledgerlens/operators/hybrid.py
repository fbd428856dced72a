"""Vector and BM25 lists fused by reciprocal ranks, exactly, by a threshold algorithm.

Fagin, Lotem and Naor, "Optimal Aggregation Algorithms for Middleware" (2001): both lists
are read from the top, what one list shows is looked up in the other, and reading stops
where nothing unseen can win. Here lists are distributed, so the depth at which that
holds is known beforehand, and a look-up is a rank: how many rows of the corpus are ahead. The
spread of each query's scores bounds that rank, so only the few candidates that may win or
tie are counted out.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.blocked_topk import Limits, QuerySize, Scorer, over_parts, part_ranks, top_and_spread
from ledgerlens.operators.fusion import RRF_CONSTANT, reciprocal_rank_fusion
from ledgerlens.operators.lexical_search import query_terms, term_counts
from ledgerlens.operators.ranking import top_per_group
from ledgerlens.operators.vector_search import cosine, prepared_vectors
from ledgerlens.session import materialise


def depth_for(k: int) -> int:
    """How deep both lists must be read so that no winner is missed.

    The first k rows of one list score at least 1 / (60 + k) each. A row
    outside the first D of both lists scores at most 2 / (61 + D), which is
    less by more than the last of six places if D is about 60 + 2k. Lists
    shorter than k are read whole.
    """
    least = 1 / (RRF_CONSTANT + k) - 1e-6
    if least <= 0:
        raise ValueError("too many rows asked for scores of six places")
    return max(k, math.ceil(2 / least - RRF_CONSTANT - 1))


class _List:
    """One ranked list of a part of the queries."""

    def __init__(self, queries: pa.Table, rows: DataFrame, scorer: Scorer, limits: Limits):
        self.queries, self.rows, self.scorer, self.limits = queries, rows, scorer, limits
        self.query, self.doc = queries.schema.names[0], rows.columns[0]

    def numbered(self, pairs: DataFrame, *columns: str) -> pa.Table:
        """Pairs of this list's queries, with the query's number in place of its key."""
        table = pairs.select(self.query, *columns).toArrow()
        number = pc.index_in(table.column(0).cast(self.queries.column(0).type), value_set=self.queries.column(0).combine_chunks())
        table = table.set_column(0, "_number", number)
        return table.filter(pc.is_valid(table.column(0)))

    def read(self, deep: int, asked: DataFrame | None) -> None:
        """The first ``deep`` rows, the scores of the pairs asked for, and the spread of all scores: one scan."""
        pairs = self.numbered(asked, self.doc) if asked is not None else pa.table({"_n": pa.array([], pa.int64()), "_d": pa.array([], pa.int64())})
        self.deep = deep
        self.found = materialise(top_and_spread(self.queries, self.rows, pairs, self.scorer, deep, self.limits), "list")
        order = [F.desc("score"), F.asc(self.doc)]
        ranked = top_per_group(self.found.where("bin IS NULL"), self.query, order, deep)
        self.top = materialise(ranked.select(self.query, self.doc, "rank"), "top")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """(query, doc, score, least, most): bounds of the ranks of those pairs that this list holds beyond its top."""
        spread = self.found.where("rows IS NOT NULL").groupBy(self.query, "bin").agg(F.sum("rows").alias("rows"))
        ahead = Window.partitionBy(self.query).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        spread = spread.withColumn("_ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
        scored = self.found.where("bin IS NOT NULL AND rows IS NULL").select(self.query, self.doc, "score", "bin").join(
            pairs, [self.query, self.doc], "left_semi"
        )
        return scored.join(spread, [self.query, "bin"]).select(
            self.query, self.doc, "score", F.greatest(F.col("_ahead") + 1, F.lit(self.deep + 1)).alias("least"),
            (F.col("_ahead") + F.col("rows")).alias("most"),
        )


def _share(rank: Column) -> Column:
    return F.coalesce(1.0 / (RRF_CONSTANT + rank), F.lit(0.0))


def _part(dense: _List, lexical: _List, k: int) -> DataFrame:
    """The fused list of one part of the queries."""
    query, doc = dense.query, dense.doc
    deep = depth_for(k)
    lexical.read(deep, None)
    dense.read(deep, lexical.top)
    # The lexical list is read again for what the dense one shows; its rows are the short written ones.
    lexical.read(deep, dense.top)
    candidates = None
    for own, other in ((dense, lexical), (lexical, dense)):
        there = own.bounded(other.top.join(own.top, [query, doc], "left_anti"))
        known = own.top.select(query, doc, F.lit(None).cast("double").alias("score"), F.col("rank").alias("least"), F.col("rank").alias("most"))
        rows = known.unionByName(there).withColumn("_list", F.lit(0 if own is dense else 1))
        candidates = rows if candidates is None else candidates.unionByName(rows)
    pick = lambda i, c: F.max(F.when(F.col("_list") == i, F.col(c)))
    fused = candidates.groupBy(query, doc).agg(
        *[pick(i, c).alias(f"_{c}{i}") for i in (0, 1) for c in ("score", "least", "most")]
    )
    # The k-th best score that is certain; who cannot reach it is out. Scores are compared to six places.
    fused = fused.select(
        "*", F.round(_share(F.col("_most0")) + _share(F.col("_most1")) - 1e-9, 6).alias("_low"),
        F.round(_share(F.col("_least0")) + _share(F.col("_least1")) + 1e-9, 6).alias("_high"),
    )
    kth = top_per_group(fused.select(query, doc, "_low"), query, [F.desc("_low"), F.asc(doc)], k).groupBy(query).agg(
        F.when(F.count(F.lit(1)) == k, F.min("_low")).otherwise(0.0).alias("_kth")
    )
    open_ = materialise(fused.join(kth, query).where(F.col("_high") >= F.col("_kth")).drop("_low", "_high", "_kth"), "open")
    lists = []
    for i, own in enumerate((dense, lexical)):
        here = open_.where(f"_least{i} IS NOT NULL")
        settled = here.where(f"_least{i} = _most{i}").select(query, doc, F.col(f"_least{i}").alias("rank"))
        unsettled = own.numbered(here.where(f"_least{i} < _most{i}").withColumnRenamed(f"_score{i}", "_score"), doc, "_score")
        placed = part_ranks(own.queries, own.rows, unsettled, own.scorer, own.limits)
        lists.append(settled.unionByName(placed.select(query, doc, F.col("rank").cast(settled.schema["rank"].dataType))))
    return reciprocal_rank_fusion(lists, k, query, doc)


def hybrid_topk(
    queries: DataFrame,
    vectors: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_key: str = "query_id",
    corpus_key: str = "doc_id",
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_key, corpus_key, score, lists, rank): the ``k`` best by the sum of 1 / (60 + rank) over both lists.

    ``queries`` have a text and an embedding, ``vectors`` embeddings and
    ``corpus`` texts. Ranks are those in the full lists. The texts are read
    once, the vectors twice: for the first rows of the list, the scores of
    what the other list shows and the spread of all scores, and then to count
    who is ahead of candidates whose rank may still decide. Rows of a query
    that a list does not hold, for want of a vector or of a common term, get
    nothing from that list.
    """
    asked, size = query_terms(queries, query_key, "text")
    q, rows, vector_size = prepared_vectors(queries, vectors, query_key, corpus_key, "embedding")
    both = queries.select(query_key)
    count = max(size.count, vector_size.count)
    # With a query go the candidates of both lists, for which scores and ranks are asked.
    whole = QuerySize(count, size.bytes + vector_size.bytes + 48 * depth_for(k) * count)

    def part(some: DataFrame) -> DataFrame:
        counts = term_counts(asked.join(some, query_key, "left_semi").toArrow(), corpus, corpus_key, "text")
        own = q.join(some, query_key, "left_semi").toArrow()
        return _part(_List(own, rows, cosine, limits), _List(counts.queries, counts.rows, counts.scorer, limits), k)

    return over_parts(both, whole, limits, part)
