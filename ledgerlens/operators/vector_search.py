"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.blocked_topk import Limits, Prepared, QuerySize, blocked_topk


CELLS = 1_000_000  # numbers of pairs that are multiplied at a time


def _matrix(rows: pa.Table) -> np.ndarray:
    lists = rows.column(1).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def cosine(queries: pa.Table) -> Prepared:
    q = _matrix(queries)
    q /= np.linalg.norm(q, axis=1, keepdims=True)

    def score(rows: pa.Table) -> np.ndarray:
        x = _matrix(rows)
        scores = x @ q.T
        scores /= np.linalg.norm(x, axis=1, keepdims=True)
        return scores

    def rough(rows: pa.Table) -> np.ndarray:
        x = _matrix(rows)
        with np.errstate(all="ignore"):
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            return x.astype(np.float32) @ single.T

    def pairs(rows: pa.Table, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        x = _matrix(rows)
        scores = np.empty(len(row))
        step = max(1, CELLS // max(1, width))
        for i in range(0, len(row), step):
            some = slice(i, i + step)
            scores[some] = np.einsum("ij,ij->i", x[row[some]], q[query[some]])
        scores /= np.linalg.norm(x, axis=1)[row]
        return scores

    width = q.shape[1]
    single = q.astype(np.float32)
    # Unit vectors: each of the products, sums and conversions is off by half a digit of 24 at most, counted twice here.
    return Prepared(score, np.full(len(q), -1.0), np.ones(len(q)), rough, pairs, (width + 8) * 2.0**-23)


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a vector that has a direction: finite numbers only, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(key, vector).where(
        F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    )


def prepared_vectors(
    queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, vector: str
) -> tuple[DataFrame, DataFrame, QuerySize]:
    """Usable queries and corpus rows of one width, the longest query's, and the size of the queries."""
    q = _usable(queries, query_key, vector)
    width = q.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
    q = q.where(F.size(vector) == width)
    count = q.count()
    c = _usable(corpus, corpus_key, vector).where(F.size(vector) == width)
    return q, c, QuerySize(count, count * width * 8)


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_key: str = "query_id",
    corpus_key: str = "doc_id",
    vector: str = "embedding",
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_key, corpus_key, score, rank): the ``k`` most similar corpus rows per query.

    Similarities are rounded to six places and ties go to the smaller key.
    Only keys and vectors enter the ranking; join the text to the winners.
    Rows without a vector, with a zero vector, or with missing, infinite or
    undefined numbers in it have no similarity and are left out, and so are
    vectors of another length than the longest query.
    """
    q, c, size = prepared_vectors(queries, corpus, query_key, corpus_key, vector)
    return blocked_topk(q, c, cosine, k, size, limits)
