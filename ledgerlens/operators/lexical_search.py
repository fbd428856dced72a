"""BM25 ranking (Robertson and Zaragoza 2009) of texts as they come, without a stored index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import terms
from ledgerlens.operators.blocked_topk import Limits, Prepared, QuerySize, Scorer, over_parts, part_topk
from ledgerlens.session import materialise

# The usual saturation and length parameters.
K1 = 1.2
B = 0.75


def inverse_frequency(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The positive form of the inverse document frequency."""
    return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, key: str, text: str) -> tuple[DataFrame, QuerySize]:
    """(key, _terms): the distinct terms of every query that has one, and the size of that."""
    asked = queries.select(key, F.array_distinct(terms(F.col(text))).alias("_terms")).where(F.size("_terms") > 0)
    count, n_terms, n_bytes = asked.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("_terms")), F.lit(0)),
        F.coalesce(F.sum(F.octet_length(F.array_join("_terms", ""))), F.lit(0)),
    ).first()
    return asked, QuerySize(count, n_bytes + 32 * n_terms)


@dataclass(frozen=True)
class TermCounts:
    """One part of the queries over a corpus: ``queries`` with the numbers and weights of their terms, and how often
    which document holds these terms, written once. ``rows`` has (key, _length, _codes, _tfs)."""

    queries: pa.Table
    rows: DataFrame
    scorer: Scorer


def term_counts(queries: pa.Table, corpus: DataFrame, key: str, text: str, k1: float = K1, b: float = B) -> TermCounts:
    """One scan of the texts for the terms of ``queries`` (key, terms).

    What frequencies, scores and ranks need of a document is its length and
    how often it holds the query terms. That is kept of documents that hold
    one; of all documents their number and total length are summed.
    """
    asked = queries.column(1).combine_chunks()
    vocabulary = asked.flatten().unique().sort()
    shared = corpus.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_words = 0
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            n_docs, n_words = n_docs + len(lengths), n_words + int(lengths.sum())
            known = pc.index_in(lists.flatten(), value_set=shared.value)
            hit = known.is_valid().to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(len(lengths)), lengths)[hit] * len(shared.value) + known.drop_null().to_numpy()
            cell, tf = np.unique(cell, return_counts=True)
            doc, code = np.divmod(cell, max(len(shared.value), 1))
            some, at = np.unique(doc, return_index=True)
            offsets = pa.array(np.r_[at, len(cell)], pa.int32())
            as_lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (code, tf)]
            nothing = pa.nulls(len(some), pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(pa.array(some)), pa.array(lengths[some]), *as_lists, nothing, nothing], names
            )
        if n_docs:
            empty = [pa.nulls(1, f.type) for f in (pa.field("", kind), pa.field("", pa.int64()), *[pa.field("", pa.list_(pa.int32()))] * 2)]
            yield pa.record_batch([*empty, pa.array([n_docs]), pa.array([n_words])], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(corpus.schema[key].dataType)
    names = [key, "_length", "_codes", "_tfs", "_docs", "_words"]
    fields = f"`{key}` {corpus.schema[key].dataType.simpleString()}, _length bigint, _codes array<int>, _tfs array<int>, _docs bigint, _words bigint"
    docs = corpus.select(key, terms(F.col(text)).alias("_terms")).where("_terms IS NOT NULL")
    written = materialise(docs.mapInArrow(count, fields), "term-counts")
    n_docs, n_words = written.agg(F.coalesce(F.sum("_docs"), F.lit(0)), F.coalesce(F.sum("_words"), F.lit(0))).first()
    rows = written.where("_docs IS NULL").select(*names[:4])
    # A row per term of this part of the queries, which is as large as a broadcast may be.
    found = rows.select(F.explode("_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    idf = np.where(df > 0, inverse_frequency(df, n_docs), 0.0)
    codes = pc.index_in(asked.flatten(), value_set=vocabulary).to_numpy()
    lists = [pa.ListArray.from_arrays(asked.offsets, pa.array(x)) for x in (codes, idf[codes])]
    table = pa.table([queries.column(0).combine_chunks(), *lists], names=[queries.schema.names[0], "_codes", "_idf"])
    return TermCounts(table, rows, _bm25(k1, b, n_words / max(n_docs, 1)))


def _bm25(k1: float, b: float, mean_length: float) -> Scorer:
    def prepare(queries: pa.Table) -> Prepared:
        lists = queries.column("_codes").combine_chunks()
        query = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        codes = lists.flatten().to_numpy()
        idf = queries.column("_idf").combine_chunks().flatten().to_numpy()
        order = np.argsort(codes, kind="stable")
        wanted, starts = np.unique(codes[order], return_index=True)
        ends = np.r_[starts[1:], len(codes)]

        def score(rows: pa.Table) -> np.ndarray:
            found = rows.column("_codes").combine_chunks()
            doc = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy())
            code = found.flatten().to_numpy()
            tf = rows.column("_tfs").combine_chunks().flatten().to_numpy()
            length = rows.column("_length").to_numpy()
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean_length))
            place = np.searchsorted(wanted, code)
            hit = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == code)
            hit = hit[np.argsort(place[hit], kind="stable")]
            scores = np.zeros((len(found), len(lists)))
            cuts = np.flatnonzero(np.diff(place[hit])) + 1
            for some in np.split(hit, cuts) if len(hit) else []:
                who = order[starts[place[some[0]]] : ends[place[some[0]]]]
                scores[np.ix_(doc[some], query[who])] += np.outer(weight[some], idf[who])
            scores[scores == 0] = -np.inf
            return scores

        return Prepared(score, np.zeros(len(lists)), np.bincount(query, idf, len(lists)) * (k1 + 1))

    return prepare


def bm25_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_key: str = "query_id",
    corpus_key: str = "doc_id",
    query_text: str = "text",
    corpus_text: str = "text",
    k1: float = K1,
    b: float = B,
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_key, corpus_key, score, rank): the ``k`` best documents per query.

    A query counts each of its terms once; documents sharing no term with it
    are not listed, and documents without a text are not counted. The texts
    are read once for all queries that fit a broadcast.
    """
    asked, size = query_terms(queries, query_key, query_text)

    def part(some: DataFrame) -> DataFrame:
        counts = term_counts(some.toArrow(), corpus, corpus_key, corpus_text, k1, b)
        return part_topk(counts.queries, counts.rows, counts.scorer, k, limits)

    return over_parts(asked, size, limits, part)
