"""Approximate nearest neighbours over balanced posting lists.

After Chen et al., "SPANN: Highly-efficient Billion-scale Approximate Nearest
Neighbor Search" (2021). Vectors lie in posting lists around centroids. A
vector near the boundary of lists is copied to several of them. The centroids,
bounded in number, are kept in memory as a navigable graph; a query walks it to
its nearest centroids and searches the lists whose centroids are hardly further
than the nearest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, below

_SPREAD = np.float32  # what the index compares in; scores are doubles


@dataclass(frozen=True)
class Settings:
    """Sizes and ratios of the index."""

    sample: int = 50_000  # vectors that centroids and the ratio are fitted on
    rows_per_list: int = 256
    max_centroids: int = 4096  # bounds the graph that is broadcast
    copies: int = 4  # lists a vector may lie in
    copy_ratio: float = 1.25  # of the distance to the nearest centroid
    recall: float = 0.97  # what the search ratio is calibrated for, on the sample
    test_queries: int = 256
    degree: int = 24  # links of a centroid
    beam: int = 32  # centroids kept while walking to those of a row; a query's walk is as wide as its lists are many
    rows_per_block: int = 4096  # of a posting list
    queries_per_block: int = 1024


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between two sets of rows."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.maximum(d, 0)


def balanced_centroids(x: np.ndarray, n: int, seed: int = 11, branch: int = 8) -> np.ndarray:
    """About ``n`` centroids with near-equal numbers of sample rows.

    Top down: a group with more rows than its share is cut into at most
    ``branch`` parts by a k-means that charges crowded parts, until every
    group is small enough or its rows are all equal.
    """
    rng = np.random.default_rng(seed)
    most = max(1, -(-len(x) // max(n, 1)))
    todo, done = [x], []
    while todo:
        part = todo.pop()
        if len(part) <= most or not np.ptp(part, axis=0).any():
            done.append(part.mean(axis=0))
            continue
        k = min(branch, -(-len(part) // most))
        centre = part[rng.choice(len(part), k, replace=False)]
        load = np.full(k, len(part) / k)
        for _ in range(10):
            d = _distances(part, centre)
            own = np.argmin(d + d.mean() * 0.5 * (load * k / len(part) - 1)[None, :], axis=1)
            load = np.bincount(own, minlength=k).astype(np.float64)
            for j in np.flatnonzero(load):
                centre[j] = part[own == j].mean(axis=0)
        pieces = [part[own == j] for j in range(k) if load[j]]
        if len(pieces) == 1:
            order = np.argsort(part[:, int(np.argmax(part.var(axis=0)))], kind="stable")
            pieces = np.array_split(part[order], 2)
        todo += pieces
    return np.array(done, _SPREAD)


@dataclass(frozen=True)
class CentroidGraph:
    """Centroids with links to near ones, some of them long, and a few entry points."""

    centre: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centre: np.ndarray, degree: int, seed: int = 5) -> CentroidGraph:
        """Two thirds of a centroid's links go to its nearest ones, the rest anywhere, and all go both ways where there is room."""
        n = len(centre)
        rng = np.random.default_rng(seed)
        near = min(n - 1, max(1, 2 * degree // 3))
        far = min(n, degree) - near if n > 1 else 0
        links = np.zeros((n, near + max(far, 0)), np.int32)
        for start in range(0, n, 1024):
            d = _distances(centre[start : start + 1024], centre)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            if near:
                links[start : start + len(d), :near] = np.argpartition(d, near - 1, axis=1)[:, :near]
        if far > 0:
            links[:, near:] = rng.integers(0, n, (n, far))
        # A nearest neighbour that does not link back gets a link in place of a random one.
        for i in range(n):
            for j in links[i, : near // 2]:
                if far > 0 and i not in links[j]:
                    links[j, near + rng.integers(far)] = i
        return CentroidGraph(centre, links, np.unique(rng.integers(0, n, min(n, 32))).astype(np.int32))

    def search(self, x: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the ``k`` nearest per row, nearest first; best-first walks, a batch at a time.

        Graphs hardly larger than the beam are looked through.
        """
        n, k = len(self.centre), min(k, len(self.centre))
        if n <= 2 * beam:
            d = _distances(x, self.centre)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            return order, np.take_along_axis(d, order, 1)
        rows = np.arange(len(x))[:, None]
        norm = (self.centre * self.centre).sum(1)
        own = (x * x).sum(1)[:, None]
        seen = np.zeros((len(x), n), bool)

        def measure(ids: np.ndarray) -> np.ndarray:
            d = own + norm[ids] - 2 * np.einsum("bd,bkd->bk", x, self.centre[ids])
            d[seen[rows, ids]] = np.inf
            seen[rows, ids] = True
            return d

        ids = np.tile(self.entries, (len(x), 1))
        dist = measure(ids)
        opened = np.isinf(dist)
        for _ in range(4 * n):
            pick = np.argsort(np.where(opened, np.inf, dist), axis=1)[:, :4]
            live = ~np.take_along_axis(opened, pick, 1) & np.isfinite(np.take_along_axis(dist, pick, 1))
            if not live.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            more = self.links[np.take_along_axis(ids, pick, 1)].reshape(len(x), -1)
            # A centroid that several of the opened ones link to counts once.
            order = np.sort(more, axis=1)
            twice = np.zeros_like(order, bool)
            twice[:, 1:] = order[:, 1:] == order[:, :-1]
            d = measure(order)
            d[twice | ~live.any(axis=1)[:, None]] = np.inf
            ids, dist, opened = np.hstack([ids, order]), np.hstack([dist, d]), np.hstack([opened, np.isinf(d)])
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, opened = (np.take_along_axis(a, best, 1) for a in (ids, dist, opened))
        return ids[:, :k], np.maximum(dist[:, :k], 0)


def lists_of(graph: CentroidGraph, x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, taken): the lists a row is copied to: those hardly further than the nearest one.

    A list whose centroid lies much closer to one already taken than to the row adds nothing.
    """
    ids, dist = graph.search(x, s.copies, max(s.copies, s.beam))
    taken = (dist <= s.copy_ratio**2 * dist[:, :1] + 1e-12) & np.isfinite(dist)
    taken[:, 0] = True
    for c in range(1, ids.shape[1]):
        gap = ((graph.centre[ids[:, c], None, :] - graph.centre[ids[:, :c]]) ** 2).sum(-1)
        taken[:, c] &= ~((gap < 0.3 * dist[:, c : c + 1]) & taken[:, :c]).any(axis=1)
    return ids, taken


@dataclass(frozen=True)
class Reach:
    """Lists within ``ratio`` of the nearest centroid's distance, or of ``least`` if that is closer, are searched."""

    ratio: float
    least: float
    lists: int  # that nearly all queries stay below

    @staticmethod
    def fit(graph: CentroidGraph, sample: np.ndarray, k: int, s: Settings, seed: int = 3) -> Reach:
        """The ratio at which queries from the sample find ``recall`` of their neighbours in it."""
        x = sample.astype(_SPREAD)
        own = [lists_of(graph, x[i : i + 256], s) for i in range(0, len(x), 256)]
        ids, taken = (np.concatenate(a) for a in zip(*own))
        some = np.random.default_rng(seed).choice(len(x), min(s.test_queries, len(x)), replace=False)
        to_lists = np.sqrt(_distances(x[some], graph.centre))
        least = float(np.median(to_lists.min(axis=1)))
        nearest_list = np.maximum(to_lists.min(axis=1), max(least, 1e-12))
        needed = []
        for i, row in enumerate(some):
            d = _distances(x[row : row + 1], x)[0]
            d[row] = np.inf
            for j in np.argsort(d, kind="stable")[: min(k, len(x) - 1)]:
                needed.append(to_lists[i, ids[j][taken[j]]].min() / nearest_list[i])
        ratio = max(1.0, float(np.quantile(needed, s.recall))) if needed else 1.0
        counts = (to_lists <= ratio * nearest_list[:, None]).sum(axis=1)
        return Reach(ratio, least, int(np.quantile(counts, 0.99)) + 1)


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of rows with an id and a vector that is not zero and holds finite numbers only."""
    numbers = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("_id"), numbers.alias("_v")).where(
        F.col("_id").isNotNull()
        & F.col("_v").isNotNull()
        & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("_v", lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame, is_query, k: int = 10, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): about the ``k`` nearest other rows of every row that ``is_query`` marks.

    Scores are Euclidean distances of the original vectors in double
    precision; ties go to the smaller id. Rows without an id, and vectors that
    are missing, zero, or hold missing or non-finite numbers, take no part;
    nor do vectors of another length than the one most rows have (of several,
    the shortest). Rows that repeat an id are candidates once, with their
    smallest vector. Fewer candidates than ``k`` are all returned: a query
    takes lists until they hold k + 1 rows, whatever the ratios say. Empty
    tables give an empty table. Other columns are ignored.

    Centroids, and the ratio up to which lists are searched, are fitted on a
    bounded sample; all rows are indexed. Lists are
    joined with the queries that search them in blocks of bounded size, so a
    vector that a third of all rows share is spread over many tasks; blocks
    give k rows per query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable_vectors(vectors, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v"))
    rows, _ = scratch.save(rows)
    widths = rows.groupBy(F.size("_v").alias("_w")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_w").first()
    empty = spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    if widths is None:
        return empty
    rows = rows.where(F.size("_v") == widths["_w"])
    # The sample: ids whose hash is below a bound that so many pass; the others never leave their tasks.
    sample = _matrix(below(rows, settings.sample / widths["_n"], "_id").select("_id", "_v").orderBy("_id").toArrow().column(1))
    n = int(min(settings.max_centroids, max(1, widths["_n"] // settings.rows_per_list), max(1, len(sample) // 2)))
    graph = CentroidGraph.build(balanced_centroids(sample, n), settings.degree)
    # As bytes that carry the class along: workers need no copy of the package to read them.
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(graph))
    reach = Reach.fit(graph, sample, k, settings)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, graph = settings, cloudpickle.loads(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = _matrix(part.column(1)).astype(_SPREAD)
                ids, near = lists_of(graph, x, s)
                row, copy = np.nonzero(near)
                yield pa.record_batch(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(ids[row, copy].astype(np.int32)), pa.array(copy == 0)],
                    ["_id", "_v", "_list", "_first"],
                )

    kind = rows.schema["_id"].dataType.simpleString()
    postings, _ = scratch.save(rows.mapInArrow(assign, f"_id {kind}, _v array<double>, _list int, _first boolean"))
    # As many rows as there are centroids, a bounded number.
    counts = {r[0]: (r[1], r[2]) for r in postings.groupBy("_list").agg(F.count(F.lit(1)), F.count_if("_first")).collect()}
    sizes = spark.sparkContext.broadcast(np.array([counts.get(i, (0, 0))[1] for i in range(len(graph.centre))]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = cloudpickle.loads(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x, lists = _matrix(part.column(1)).astype(_SPREAD), reach.lists
                while part.num_rows:
                    ids, dist = graph.search(x, lists, max(lists, settings.beam))
                    within = (dist <= reach.ratio**2 * np.maximum(dist[:, :1], reach.least**2) + 1e-12) & np.isfinite(dist)
                    held = np.cumsum(sizes.value[ids], axis=1)
                    # Where the last list found is still inside the ratio, there may be more: walk again, twice as far.
                    further = within[:, -1] & (lists < len(graph.centre))
                    within[:, 1:] |= held[:, :-1] <= k
                    for r in np.flatnonzero(((held[:, -1] <= k) | ~np.isfinite(dist).all(axis=1)) & ~further):
                        # The walk's lists hold too few rows: take all lists, nearest first, until there are enough.
                        order = np.argsort(_distances(x[r : r + 1], graph.centre)[0], kind="stable")
                        need = int(np.searchsorted(np.cumsum(sizes.value[order]), k, side="right")) + 1
                        taken = order[: max(need, 1)]
                        yield _choice(part.slice(int(r), 1), np.zeros(len(taken), np.int64), taken)
                        within[r] = False
                    row, place = np.nonzero(within & ~further[:, None])
                    yield _choice(part, row, ids[row, place])
                    part, x, lists = part.filter(pa.array(further)), x[further], min(2 * lists, len(graph.centre))

    def _choice(part: pa.RecordBatch, row: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
        take = pa.array(row)
        return pa.record_batch(
            [part.column(0).take(take), part.column(1).take(take), pa.array(lists.astype(np.int32))], ["_id", "_v", "_list"]
        )

    queries = rows.where(is_query(F.col("_id"))).mapInArrow(choose, f"_id {kind}, _v array<double>, _list int")
    queries, _ = scratch.save(queries)
    asked = {r[0]: r[1] for r in queries.groupBy("_list").agg(F.count(F.lit(1))).collect()}

    # Blocks per list, from counts per centroid: a table as small as the graph.
    blocks = spark.createDataFrame(
        [(i, -(-c[0] // settings.rows_per_block), -(-asked.get(i, 0) // settings.queries_per_block)) for i, c in counts.items() if i in asked],
        "_list int, _nr int, _nq int",
    )

    def dealt(df: DataFrame, own: str, other: str, col: str, other_col: str) -> DataFrame:
        block = F.pmod(F.xxhash64("_id"), F.col(own)).cast("int").alias(col)
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_col)
        joined = df.join(F.broadcast(blocks), "_list")
        return joined.select("_id", "_v", "_list", block, other, own).select("_id", "_v", "_list", col, every)

    left = dealt(queries, "_nq", "_nr", "_q", "_r")
    right = dealt(postings.select("_id", "_v", "_list"), "_nr", "_nq", "_r", "_q")

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        out = _topk(q, c, k)
        return pa.table([pa.array(a) for a in out], names=["query_id", id_col, "score"])

    keys = ["_list", "_q", "_r"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query_id {kind}, `{id_col}` {kind}, score double")
    best = Window.partitionBy("query_id").orderBy("score", id_col)
    return (
        near.distinct()  # copies of a vector in several lists
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(F.col("query_id").cast("bigint"), "rank", F.col(id_col).cast("bigint"), "score")
    )


def _topk(queries: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows per query of one block, by exact differences, with ties to smaller ids."""
    if not queries.num_rows or not rows.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qid, rid = queries.column("_id").to_numpy(), rows.column("_id").to_numpy()
    q, x = _matrix(queries.column("_v")), _matrix(rows.column("_v"))
    order = np.argsort(rid, kind="stable")
    rid, x = rid[order], x[order]
    out: list[tuple] = []
    rough = _distances(q, x)
    slack = 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max())
    rough[qid[:, None] == rid[None, :]] = np.inf
    for i in range(len(q)):
        # The product form is rounded; whatever may be among the k best is measured exactly.
        kth = np.partition(rough[i], min(k, len(x)) - 1)[min(k, len(x)) - 1]
        some = np.flatnonzero(rough[i] <= kth + slack[i]) if np.isfinite(kth) else np.flatnonzero(np.isfinite(rough[i]))
        d = np.sqrt(((x[some] - q[i]) ** 2).sum(axis=1))
        first = np.lexsort((rid[some], d))[:k]
        out.append((np.full(len(first), qid[i]), rid[some][first], d[first]))
    return tuple(np.concatenate(c) for c in zip(*out))
