"""A stored inverted index, and BM25 search that reads only what can win.

Layout under the index folder, written in segments so that documents can be added:

* ``postings``: (bucket, segment, term, block, docs, tfs, lengths), a row per term and block of
  documents, partitioned by a bucket of terms and sorted by term.
* ``impacts``: (bucket, segment, term, block, df, impacts), the same rows without documents: how
  many there are, and the pairs of frequency and length that no other pair of the block beats.
* ``documents``: (segment, docs, words, key), a row per segment, with the type of the keys.

A term that most documents hold is many rows, one per block, and no task holds more than
one block's documents. Bounds come from the impacts, so they hold for all parameters and
any later mean length (Ding and Suel, "Faster Top-k Document Retrieval Using Block-Max
Indexes", 2011; impacts as pairs as in Lucene).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import terms
from ledgerlens.operators.blocked_topk import SCORE_DIGITS, Limits
from ledgerlens.operators.lexical_search import B, K1, query_terms
from ledgerlens.operators.ranking import top_per_group
from ledgerlens.session import materialise

DOCS_PER_BLOCK = 1024
WORDS_PER_BLOCK = 1_000_000  # a block of longer documents has fewer; bounds the memory of a task
BUCKETS = 64
QUERIES_PER_TASK = 2048
_PARTS = ("postings", "impacts", "documents")


def _impacts(code: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the pairs that no other pair of their term beats: by term, the most frequent first."""
    order = np.lexsort((length, -tf, code))
    # Later terms lie below all earlier ones, so the running least is that of the term.
    low = length[order] - code[order] * (length.max(initial=0) + 1)
    return order[np.r_[True, low[1:] < np.minimum.accumulate(low)[:-1]][: len(order)]]


def posting_blocks(docs: DataFrame, key: str, text: str, docs_per_block: int = DOCS_PER_BLOCK) -> DataFrame:
    """(term, block, docs, tfs, lengths, df, impacts) of the documents that have a text, and per task how many there are.

    A block is a run of documents of one task, cut earlier where they have
    very many words, so lists are made where the texts are read and nothing
    is shuffled. The rows that count documents and words have no term.
    """

    def build(block: int, keys: pa.Array, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        order = pc.sort_indices(keys)
        keys, lists = keys.take(order), lists.take(order)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        cell, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        code, doc = np.divmod(cell, len(sizes))
        length = sizes[doc]
        best = _impacts(code, tf, length)
        of = np.arange(len(words.dictionary) + 1)
        cuts, best_cuts = pa.array(np.searchsorted(code, of), pa.int32()), pa.array(np.searchsorted(code[best], of), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array(tf[best], pa.int32()), pa.array(length[best], pa.int32())], ["tf", "length"])
        lists = [pa.ListArray.from_arrays(cuts, x) for x in (keys.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(length, pa.int32()))]
        n = len(words.dictionary)
        made = pa.table(
            [words.dictionary, pa.array(np.full(n, block)), *lists, pa.array(np.diff(cuts), pa.int64()), pa.ListArray.from_arrays(best_cuts, pairs), *[pa.nulls(n, pa.int64())] * 2],
            names=names,
        )
        yield from made.to_batches(max_chunksize=10_000)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, total, n_words = TaskContext.get().partitionId() << 32, 0, 0
        waiting, rows, words = [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            return build(block, table.column(0).combine_chunks(), table.column(1).combine_chunks())

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            start, before = 0, 0
            while start < batch.num_rows:
                # As many documents as the block still takes, one at least.
                fit = int(np.searchsorted(ends, before + WORDS_PER_BLOCK - words, "right")) - start
                take = min(batch.num_rows - start, docs_per_block - rows, max(fit, 0 if rows else 1))
                if take:
                    waiting.append(batch.slice(start, take))
                    start, rows = start + take, rows + take
                    words, before = words + int(ends[start - 1]) - before, int(ends[start - 1])
                if start < batch.num_rows or rows == docs_per_block:
                    yield from close()
                    block, total, n_words = block + 1, total + rows, n_words + words
                    waiting, rows, words = [], 0, 0
        if rows:
            yield from close()
            total, n_words = total + rows, n_words + words
        if total:
            nothing = [pa.nulls(1, f.type) for f in schema][:-2]
            yield pa.record_batch([*nothing, pa.array([total]), pa.array([n_words])], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[key].dataType.simpleString()
    fields = T.StructType.fromDDL(
        f"term string, block bigint, docs array<{kind}>, tfs array<int>, lengths array<int>, df bigint, "
        "impacts array<struct<tf:int,length:int>>, _docs bigint, _words bigint"
    )
    schema, names = to_arrow_schema(fields), fields.names
    rows = docs.select(key, terms(F.col(text)).alias("_terms")).where("_terms IS NOT NULL")
    return rows.mapInArrow(blocks, fields)


def write_segment(
    docs: DataFrame,
    path: str,
    segment: int = 0,
    key: str = "doc_id",
    text: str = "text",
    docs_per_block: int = DOCS_PER_BLOCK,
    buckets: int = BUCKETS,
) -> None:
    """Index ``docs`` as one segment; a segment that is there already is replaced, others stay as they are.

    Keys are unique over all segments. Each text is read and cut into terms
    once, and its task makes the lists; only finished rows of many documents
    are shuffled, to their bucket. Documents without a text are not indexed.
    """
    spark = docs.sparkSession
    made = materialise(posting_blocks(docs, key, text, docs_per_block), "postings")
    total = made.agg(F.coalesce(F.sum("_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("_words"), F.lit(0)).alias("words")).first()
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    made = made.where("term IS NOT NULL")
    rows = made.select(bucket, "term", "block", "docs", "tfs", "lengths")
    impacts = made.select(bucket, "term", "block", "df", "impacts")
    kind = docs.schema[key].dataType.simpleString()
    summary = spark.createDataFrame([(total["docs"], total["words"], kind)], "docs bigint, words bigint, key string")
    for name, frame in zip(_PARTS, (rows, impacts, summary)):
        folder = f"{path}/{name}/segment={segment}"
        if name == "documents":
            frame.write.mode("overwrite").parquet(folder)
        else:
            # A bucket's rows lie together and in order; a bucket with very many is split.
            frame.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(folder)


@dataclass(frozen=True)
class Index:
    """A stored index as frames, with the number and the mean length of its documents."""

    postings: DataFrame
    impacts: DataFrame
    n_docs: int
    mean_length: float
    buckets: int


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Index:
    """All segments under ``path``; ``buckets`` as they were written."""
    total = spark.read.parquet(f"{path}/documents").agg(F.sum("docs"), F.sum("words"), F.max("key")).first()
    # Declared: an index of no documents has no file to infer from.
    place = "term string, block bigint, segment int, bucket int"
    postings = spark.read.schema(f"docs array<{total[2]}>, tfs array<int>, lengths array<int>, {place}").parquet(f"{path}/postings")
    impacts = spark.read.schema(f"df bigint, impacts array<struct<tf:int,length:int>>, {place}").parquet(f"{path}/impacts")
    return Index(postings, impacts, total[0] or 0, (total[1] or 0) / max(total[0] or 0, 1), buckets)


def _weight(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / F.lit(mean)))


class _Search:
    """One set of queries against an index."""

    def __init__(self, index: Index, wanted: DataFrame, key: str, k: int, k1: float, b: float, limits: Limits):
        self.index, self.key, self.k, self.k1, self.b = index, key, k, k1, b
        vocabulary = materialise(
            wanted.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(index.buckets)).cast("int")), "vocabulary"
        )
        n_bytes = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
        self.vocabulary = F.broadcast(vocabulary) if n_bytes <= limits.broadcast_bytes else vocabulary
        # Folders of buckets that no query term falls into are not listed, let alone read.
        self.wanted_buckets = sorted(r[0] for r in vocabulary.select("bucket").distinct().collect())
        impacts = materialise(self._pruned(index.impacts), "impacts")
        frequency = impacts.groupBy("term").agg(F.sum("df").alias("_df"))
        idf = F.log(1 + (index.n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        self.weighted = materialise(wanted.join(frequency, "term").select(key, "term", idf.alias("_idf")), "weights")
        most = F.array_max(F.transform("impacts", lambda x: _weight(x["tf"], x["length"], index.mean_length, k1, b)))
        # What a document of the block can score at most; the last of six places counts as reached.
        self.bounds = materialise(
            impacts.select("segment", "block", "term", most.alias("_most"))
            .join(self.weighted, "term")
            .groupBy(key, "segment", "block")
            .agg((F.sum(F.col("_idf") * F.col("_most")) + 1e-6).alias("_bound")),
            "bounds",
        )

    def _pruned(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("bucket").isin(self.wanted_buckets)).join(self.vocabulary, ["bucket", "term"], "left_semi")

    def score(self, blocks: DataFrame, floors: DataFrame | None) -> DataFrame:
        """(key, _doc, score) of the documents of the given (query, block) pairs, at most k of a block, none below its floor."""
        key, k, k1, b, mean = self.key, self.k, self.k1, self.b, self.index.mean_length
        place = ["segment", "block"]
        asked = blocks.join(self.weighted, key)
        # Queries of a block meet its postings in parts, so that neither many queries nor many blocks are one group.
        n_queries = self.weighted.select(key).distinct().count()
        parts = max(1, -(-n_queries // QUERIES_PER_TASK))
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        if floors is not None:
            asked = asked.join(floors, key, "left")
        else:
            asked = asked.withColumn("_floor", F.lit(None).cast("double"))
        asked = asked.select(*place, part.alias("_part"), key, "term", "_idf", F.coalesce("_floor", F.lit(float("-inf"))).alias("_floor"))
        needed = asked.select(*place, "_part", "term").distinct()
        rows = self._pruned(self.index.postings).join(needed, [*place, "term"]).select(
            *place, F.col("_part").alias("_part"), "term", "docs", "tfs", "lengths"
        )
        kind, doc_kind = blocks.schema[key].dataType.simpleString(), self.index.postings.schema["docs"].dataType.elementType.simpleString()

        def meet(queries: pa.Table, postings: pa.Table) -> pa.Table:
            names = [key, "_doc", "score"]
            terms_here = postings.column("term").combine_chunks()
            lists = postings.column("docs").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy()
            docs, own = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            tf, length = (postings.column(c).combine_chunks().flatten().to_numpy() for c in ("tfs", "lengths"))
            weight = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length / mean))
            starts = np.cumsum(sizes) - sizes
            at = pc.index_in(queries.column("term").combine_chunks(), value_set=terms_here).to_numpy(zero_copy_only=False)
            ids = queries.column(key).combine_chunks().dictionary_encode()
            query, idf, floor = ids.indices.to_numpy(), queries.column("_idf").to_numpy(), queries.column("_floor").to_numpy()
            found: list[tuple] = []
            order = np.argsort(query, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
                scores = np.zeros(len(docs))
                for i in some:
                    if not np.isnan(at[i]):
                        t = int(at[i])
                        here = slice(starts[t], starts[t] + sizes[t])
                        scores[own[here]] += idf[i] * weight[here]
                hit = np.flatnonzero(scores > 0)
                rounded = np.round(scores[hit], SCORE_DIGITS)
                fine = rounded >= floor[some[0]]
                hit, rounded = hit[fine], rounded[fine]
                first = np.lexsort((hit, -rounded))[:k]
                found.append((np.full(len(first), query[some[0]]), docs[hit[first]], rounded[first]))
            query, doc, score = (np.concatenate(c) for c in zip(*found))
            return pa.table([ids.dictionary.take(pa.array(query)), pa.array(doc), pa.array(score)], names=names)

        group = [*place, "_part"]
        return asked.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(meet, f"`{key}` {kind}, _doc {doc_kind}, score double")


def index_topk(
    queries: DataFrame,
    index: Index,
    k: int = 5,
    query_key: str = "query_id",
    corpus_key: str = "doc_id",
    query_text: str = "text",
    k1: float = K1,
    b: float = B,
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_key, corpus_key, score, rank): the ``k`` best documents per query, as a scan of the texts would rank them.

    Only postings of query terms are read, in two steps. The k blocks with
    the highest bounds of a query hold k matches or more, if there are that
    many blocks; they are scored, and the k-th score is a floor. Then only
    blocks whose bound reaches the floor are read, which leaves out most
    blocks that lack a query's rare terms. A query counts each of its terms
    once; documents sharing no term with it are not listed.
    """
    asked, _ = query_terms(queries, query_key, query_text)
    wanted = materialise(asked.select(query_key, F.explode("_terms").alias("term")), "wanted")
    search = _Search(index, wanted, query_key, k, k1, b, limits)
    order = [F.desc("_bound"), F.asc("segment"), F.asc("block")]
    place = [query_key, "segment", "block"]
    first = materialise(top_per_group(search.bounds, query_key, order, k).select(*place), "first")
    some = materialise(search.score(first, None), "first-scores")
    by_score = [F.desc("score"), F.asc("_doc")]
    kth = top_per_group(some, query_key, by_score, k).groupBy(query_key).agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_floor")
    )
    floors = materialise(kth, "floors")
    live = search.bounds.join(floors, query_key, "left").where(F.col("_floor").isNull() | (F.col("_bound") >= F.col("_floor")))
    live = materialise(live.select(*place).join(first, place, "left_anti"), "live")
    ranked = top_per_group(some.unionByName(search.score(live, floors)), query_key, by_score, k)
    return ranked.withColumnRenamed("_doc", corpus_key)
