"""Exact top-k of many queries over a large corpus without forming the pairs.

A scorer turns a block of corpus rows and a block of queries into a score
matrix inside a task; only rows that can be among the best ``k`` of all leave
it. The corpus is read in place, without a shuffle or a copy. Queries are
broadcast, in parts of bounded size, one part at a time: the corpus is scanned
once per part, and most inputs have one.

Rows that leave a task must reach the k-th best score of a few splits, which
are scored first. The last step ranks the few rows that all tasks kept. The
same scan also tells the scores of given pairs, how scores are spread, and the
exact ranks of given pairs, which a fusion of lists needs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.ranking import top_per_group
from ledgerlens.session import materialise


@dataclass(frozen=True)
class Limits:
    """Sizes that bound a broadcast and the memory of a task, and which splits are scored first."""

    broadcast_bytes: int = 64 << 20
    queries_per_block: int = 2048
    cells_per_step: int = 1_000_000
    floor_every: int = 16  # the last of every so many splits; inputs of fewer splits have no floor


@dataclass(frozen=True)
class QuerySize:
    """Measured by the caller before planning."""

    count: int
    bytes: int


class Prepared(NamedTuple):
    """Scores of corpus rows against a block of queries (``-inf`` is no match), and the span of each query's scores.

    A scorer may have a faster way to scores in single precision, which are at
    most ``error`` off; it then also scores given pairs, by row and query.
    """

    score: Callable[[pa.Table], np.ndarray]
    low: np.ndarray
    high: np.ndarray
    rough: Callable[[pa.Table], np.ndarray] | None = None
    pairs: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None
    error: float = 0.0


Scorer = Callable[[pa.Table], Prepared]  # of a block of queries

SCORE_DIGITS = 6
BINS = 1024  # of a query's scores


def rounded(scores: np.ndarray) -> np.ndarray:
    scores = np.round(scores, SCORE_DIGITS)
    return np.where(np.isnan(scores), -np.inf, scores)


def _bar(floor: np.ndarray) -> np.ndarray:
    """What no score falls short of that reaches its floor when rounded; below all numbers where there is no floor."""
    return np.maximum(floor - 2 * 10.0**-SCORE_DIGITS, np.finfo(np.float64).min)


class _Best:
    """The best k rows per query seen so far, by rounded score and then id; rows below the floors are not kept.

    Most scores fall short of the floors. They are compared once, as they
    come, and only what may reach a floor is rounded. Once all queries have a
    floor, a scorer's rough scores tell which pairs may reach it, and only
    those are scored exactly.
    """

    def __init__(self, k: int, floor: np.ndarray):
        self.k = k
        self.floor = floor.copy()
        self.bar = _bar(self.floor)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.room = max(k * len(floor), 10_000)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        # A score that is no number reaches no floor.
        hit = scores >= self.bar
        many = np.count_nonzero(hit) > self.room
        if many:
            # Floors are not known yet; of the k best of these rows no other can be ahead.
            take = min(self.k, len(ids))
            kth = np.partition(np.where(np.isnan(scores), -np.inf, scores), len(ids) - take, axis=0)[len(ids) - take]
            hit &= scores >= kth - 2 * 10.0**-SCORE_DIGITS
        row, query = np.divmod(np.flatnonzero(hit), hit.shape[1])
        self._keep(ids[row], query, scores[row, query])
        if many or self.waiting > self.room:
            self.settle()

    def add_rough(self, rows: pa.Table, prepared: Prepared) -> bool:
        """The same by rough scores; false if that needs floors that are not there yet, or tells too little."""
        if prepared.rough is None or not len(self.floor) or self.floor.min() == -np.inf:
            return False
        # What is no number as a rough score is scored as well.
        short = prepared.rough(rows) < (self.bar - prepared.error).astype(np.float32)
        cells = np.flatnonzero(~short)
        if len(cells) > self.room:
            return False
        row, query = np.divmod(cells, short.shape[1])
        self._keep(rows.column(0).to_numpy()[row], query, prepared.pairs(rows, row, query))
        if self.waiting > self.room:
            self.settle()
        return True

    def _keep(self, ids: np.ndarray, query: np.ndarray, scores: np.ndarray) -> None:
        score = np.round(scores, SCORE_DIGITS)
        fine = score >= self.floor[query]
        self.kept.append((query[fine], score[fine], ids[fine]))
        self.waiting += np.count_nonzero(fine)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rank what is kept, drop what cannot win, and raise the floors."""
        if not self.kept:
            return None
        query, score, ids = (np.concatenate(parts) for parts in zip(*self.kept))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        last = place == self.k - 1
        self.floor[query[last]] = score[last]
        self.bar = _bar(self.floor)
        self.kept = [(query[keep], score[keep], ids[keep])]
        self.waiting = 0
        return self.kept[0]


class _Pairs:
    """Given pairs of a block of queries, by corpus key."""

    def __init__(self, keys: np.ndarray, query: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.query = keys[order], query[order]

    def among(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of the pairs whose key is one of ``ids``."""
        first, last = np.searchsorted(self.keys, ids, "left"), np.searchsorted(self.keys, ids, "right")
        n = last - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.repeat(np.arange(len(ids)), n), self.query[at]


def _blocks(queries: pa.Table, limits: Limits) -> Iterator[tuple[int, pa.Table]]:
    for start in range(0, queries.num_rows, limits.queries_per_block):
        yield start, queries.slice(start, limits.queries_per_block).combine_chunks()


def _steps(rows: pa.Table, width: int, limits: Limits) -> Iterator[pa.Table]:
    step = max(1, limits.cells_per_step // max(width, 1))
    for start in range(0, rows.num_rows, step):
        yield rows.slice(start, step)


def over_parts(queries: DataFrame, size: QuerySize, limits: Limits, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` for parts of the queries that are as small as a broadcast may be, one after the other.

    Parts are cut by the hash of the query key. Where there are several, the
    result of each is written before the next one is collected, so the driver
    holds one at a time.
    """
    n = max(1, -(-size.bytes // max(limits.broadcast_bytes, 1)))
    n = min(n, max(1, size.count))
    if n == 1:
        return work(queries)
    part = F.pmod(F.xxhash64(queries.columns[0]), F.lit(n))
    return functools.reduce(DataFrame.unionByName, [materialise(work(queries.where(part == i)), "part") for i in range(n)])


def _read(corpus: DataFrame, queries: pa.Table, fields: T.StructType, work) -> DataFrame:
    """``work(queries, corpus batches)`` in every task of the corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value.num_rows:
            for found in work(shared.value, (pa.Table.from_batches([b]) for b in batches if b.num_rows)):
                yield from found.to_batches()

    return corpus.mapInArrow(run, fields)


def _fields(queries: pa.Table, corpus: DataFrame, *more: tuple[str, T.DataType]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

    key = queries.schema.field(0)
    fields = T.StructType([T.StructField(key.name, from_arrow_type(key.type)), corpus.schema[0], *(T.StructField(n, t) for n, t in more)])
    return fields, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])


def _top_scan(queries: pa.Table, tables: Iterator[pa.Table], scorer: Scorer, k: int, floor: np.ndarray, schema: pa.Schema, limits: Limits):
    """The best rows of the given ones for every query."""
    blocks = [(b.column(0), scorer(b), _Best(k, floor[at : at + b.num_rows])) for at, b in _blocks(queries, limits)]
    for rows in tables:
        for query_ids, prepared, best in blocks:
            for part in _steps(rows, len(query_ids), limits):
                if not best.add_rough(part, prepared):
                    best.add(part.column(0).to_numpy(), prepared.score(part))
    for query_ids, _, best in blocks:
        settled = best.settle()
        if settled is not None:
            query, score, ids = settled
            yield pa.table([query_ids.take(pa.array(query)), pa.array(ids), pa.array(score)], names=schema.names).cast(schema)


def score_floors(queries: pa.Table, corpus: DataFrame, scorer: Scorer, k: int, limits: Limits) -> np.ndarray:
    """For every query the exact k-th best score of a few splits, which the k-th best of all cannot fall short of.

    Splits that are not chosen are not read. Where the chosen ones hold fewer
    than ``k`` rows of a query, it has no floor.
    """
    fields, schema = _fields(queries, corpus, ("score", T.DoubleType()))
    open_floor = np.full(queries.num_rows, -np.inf)

    def some(part: pa.Table, tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % limits.floor_every == limits.floor_every - 1:
            yield from _top_scan(part, tables, scorer, k, open_floor, schema, limits)

    key, corpus_key = fields[0].name, fields[1].name
    kept = top_per_group(_read(corpus, queries, fields, some), key, [F.desc("score"), F.asc(corpus_key)], k)
    # A row per query at most.
    found = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toArrow()
    at = pc.index_in(found.column(0).cast(queries.column(0).type), value_set=queries.column(0).combine_chunks()).to_numpy()
    floor = open_floor.copy()
    floor[at] = found.column("score").to_numpy()
    return floor


def topk_candidates(queries: pa.Table, corpus: DataFrame, scorer: Scorer, k: int, limits: Limits) -> DataFrame:
    """(query key, corpus key, score): what leaves the tasks, at most k rows per query and task, none below the floor."""
    fields, schema = _fields(queries, corpus, ("score", T.DoubleType()))
    floor = score_floors(queries, corpus, scorer, k, limits)
    return _read(corpus, queries, fields, lambda part, tables: _top_scan(part, tables, scorer, k, floor, schema, limits))


def part_topk(queries: pa.Table, corpus: DataFrame, scorer: Scorer, k: int, limits: Limits = Limits()) -> DataFrame:
    """(query key, corpus key, score, rank) of the best ``k`` corpus rows for each of one part of the queries."""
    kept = topk_candidates(queries, corpus, scorer, k, limits)
    return top_per_group(kept, kept.columns[0], [F.desc("score"), F.asc(kept.columns[1])], k)


def blocked_topk(
    queries: DataFrame, corpus: DataFrame, scorer: Scorer, k: int, size: QuerySize, limits: Limits = Limits()
) -> DataFrame:
    """(query key, corpus key, score, rank) of the best ``k`` corpus rows per query.

    The first column of each input is its unique key; corpus keys are numbers.
    The other corpus columns are what the scorer reads.
    """
    return over_parts(queries, size, limits, lambda part: part_topk(part.toArrow(), corpus, scorer, k, limits))


def _bins(scores: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bin of each score in its query's span; higher scores are in the same or a higher one."""
    with np.errstate(invalid="ignore"):
        share = (scores - low) / np.where(high > low, high - low, 1)
    return np.clip(np.floor(np.nan_to_num(share, neginf=0) * BINS), 0, BINS - 1).astype(np.int64)


def top_and_spread(
    queries: pa.Table, corpus: DataFrame, pairs: pa.Table, scorer: Scorer, k: int, limits: Limits = Limits()
) -> DataFrame:
    """(query key, corpus key, score, bin, rows) from one scan, for one part of the queries.

    Three kinds of rows: the best ``k`` of each task (no bin), given pairs
    (bin, no rows), and how many rows of the task each bin of a query holds
    (no corpus key). ``pairs`` has (query number, corpus key).
    """
    fields, schema = _fields(queries, corpus, ("score", T.DoubleType()), ("bin", T.LongType()), ("rows", T.LongType()))
    number, keys = pairs.column(0).to_numpy(), pairs.column(1).to_numpy()

    def table(query_ids: pa.Array, query: np.ndarray, ids=None, score=None, bin_=None, rows=None) -> pa.Table:
        columns = [query_ids.take(pa.array(query))]
        columns += [pa.nulls(len(query), f.type) if c is None else pa.array(c) for c, f in zip((ids, score, bin_, rows), list(schema)[1:])]
        return pa.table(columns, names=schema.names).cast(schema)

    def read(part: pa.Table, tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        blocks = []
        for at, b in _blocks(part, limits):
            own = (number >= at) & (number < at + b.num_rows)
            counts = np.zeros((b.num_rows, BINS), np.int64)
            blocks.append((b.column(0), scorer(b), _Best(k, np.full(b.num_rows, -np.inf)), _Pairs(keys[own], number[own] - at), counts))
        for rows in tables:
            for query_ids, prepared, best, asked, counts in blocks:
                for some in _steps(rows, len(query_ids), limits):
                    ids, scores = some.column(0).to_numpy(), rounded(prepared.score(some))
                    best.add(ids, scores)
                    bins = _bins(scores, prepared.low, prepared.high)
                    row, query = np.nonzero(scores > -np.inf)
                    cell = query * BINS + bins[row, query]
                    counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
                    row, query = asked.among(ids)
                    found = scores[row, query] > -np.inf
                    row, query = row[found], query[found]
                    if len(row):
                        yield table(query_ids, query, ids[row], scores[row, query], bins[row, query])
        for query_ids, _, best, _, counts in blocks:
            settled = best.settle()
            if settled is not None:
                yield table(query_ids, settled[0], settled[2], settled[1])
            query, bin_ = np.nonzero(counts)
            yield table(query_ids, query, bin_=bin_, rows=counts[query, bin_])

    return _read(corpus, queries, fields, read)


def part_ranks(queries: pa.Table, corpus: DataFrame, scored: pa.Table, scorer: Scorer, limits: Limits = Limits()) -> DataFrame:
    """(query key, corpus key, rank): the exact rank of scored pairs among all corpus rows, for one part of the queries.

    ``scored`` has (query number, corpus key, score). The scan counts the rows
    that beat each pair, by score and then by key; only counts leave a task.
    """
    fields, schema = _fields(queries, corpus, ("_ahead", T.LongType()))
    number, keys, bars = (scored.column(i).to_numpy() for i in range(3))

    def count(part: pa.Table, tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
        blocks = []
        for at, b in _blocks(part, limits):
            own = np.flatnonzero((number >= at) & (number < at + b.num_rows))
            if not len(own):
                continue
            # Only queries that have pairs are scored.
            asked, query = np.unique(number[own] - at, return_inverse=True)
            few = b.take(pa.array(asked))
            blocks.append((few.column(0), scorer(few), own, query, np.zeros(len(own), np.int64)))
        # Nothing to count, nothing to read.
        for rows in tables if blocks else ():
            for _, prepared, own, query, ahead in blocks:
                for some in _steps(rows, len(own), limits):
                    ids, scores = some.column(0).to_numpy(), rounded(prepared.score(some))[:, query]
                    ahead += (scores > bars[own]).sum(axis=0)
                    row, pair = np.nonzero(scores == bars[own])
                    before = ids[row] < keys[own][pair]
                    ahead += np.bincount(pair[before], minlength=len(own))
        for query_ids, _, own, query, ahead in blocks:
            yield pa.table([query_ids.take(pa.array(query)), pa.array(keys[own]), pa.array(ahead)], names=schema.names).cast(schema)

    counts = _read(corpus, queries, fields, count)
    return counts.groupBy(*counts.columns[:2]).agg((F.sum("_ahead") + 1).alias("rank"))
