"""Spelling variants: words one edit apart, found by pivotal grams, and what they are variants of.

Deng, Li and Feng, "A Pivotal Prefix Based Filtering Algorithm for String Similarity
Search" (2014), for one edit and bigrams. Bigrams have one order for the whole
vocabulary, rare ones first. A word's prefix is its first three bigrams in that order; any
three hold two that share no letter, its pivots, of which one edit spoils one at most. So
of two words one edit apart, the one whose prefix ends earlier has a pivot that the other
word has in its prefix, at the same place or one further, which the index asks for by
bigram, place and length. What meets there is verified letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, fold, key_runs

LEAST_CHARS = 5
LEAST_COUNT = 3
TYPO_EVERY = 97
BLOCK = 8192  # words of one side of a list that meet in one task
CELLS = 1 << 19  # pairs that are compared at a time
# Fixed value: the letters of the contract.
LETTERS = "[A-Za-zÀ-ÿ]"


def word_counts(
    docs: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    typo_every: int = TYPO_EVERY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, n): the words of all texts with planted typos, and how often they occur.

    A word is a maximal run of letters, A-Z in lower case. Where
    ``typo_every`` divides the CRC-32 of ``id:word`` (a missing id is empty),
    the letter at its remainder by the word's length is left out. Shorter and
    rarer words are dropped. Counts are summed before they are shuffled, so a
    word that is a third of all is one row per task. A missing text has no words.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0)))
    ascii_only = F.octet_length("_run") == F.char_length("_run")
    size = F.char_length("_low")
    at = F.pmod(F.col("_crc"), size).cast("int")
    cut = F.concat(F.substr("_low", F.lit(1), at), F.substr("_low", at + 2))
    return (
        docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
        .select("_id", F.when(ascii_only, F.lower("_run")).otherwise(fold(F.col("_run"))).alias("_low"))
        .withColumn("_crc", F.crc32(F.concat("_id", F.lit(":"), "_low")))
        .select(F.when(F.pmod("_crc", F.lit(typo_every)) == 0, cut).otherwise(F.col("_low")).alias("word"))
        .where(F.char_length("word") >= least_chars)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_count)
    )


def _codes(words: pa.Array | list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    joined = "".join(words if isinstance(words, list) else words.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)


def _bucket(codes: np.ndarray) -> np.ndarray:
    """Numbers of the bigrams of each row; bigrams of one-byte letters have numbers of their own."""
    return ((codes[:, :-1] << 8) ^ codes[:, 1:]).astype(np.int64) & 0xFFFF


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of one length, and their code points."""
    texts = words.to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _codes([texts[i] for i in at], int(size))


def gram_order(words: DataFrame) -> np.ndarray:
    """(2, 65,536): for every bigram number its place in the order, rare first, and how many words have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, codes in _by_length(batch.column(0)):
                total += np.bincount(_bucket(codes).ravel(), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["gram", "n"])

    counts = words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # One row per bigram number at most, 65,536 of them.
    found = counts.toArrow()
    number = np.zeros(1 << 16, np.int64)
    number[found.column(0).to_numpy()] = found.column(1).to_numpy()
    place = np.empty(1 << 16, np.int64)
    place[np.lexsort((np.arange(1 << 16), number))] = np.arange(1 << 16)
    return np.stack([place, number])


def pivots(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(words, 2): of the bigrams at rising ``places``, the two without a common letter that weigh least.

    ``weights`` are the lengths of their lists. One pass keeps, for each
    bigram, the lightest alone and the lightest two up to there.
    """
    words, n = places.shape
    rows = np.arange(words)
    lightest = np.zeros((words, n), np.int64)  # index of the lightest of the first i + 1
    best = np.full(words, np.iinfo(np.int64).max)
    chosen = np.zeros((words, 2), np.int64)
    for i in range(n):
        if i:
            before = lightest[:, i - 1]
            lightest[:, i] = np.where(weights[:, i] < weights[rows, before], i, before)
        # Bigrams at least two letters before this one come up to here.
        free = (places[:, :i] <= places[:, i : i + 1] - 2).sum(axis=1)
        partner = lightest[rows, np.maximum(free - 1, 0)]
        total = np.where(free > 0, weights[:, i] + weights[rows, partner], np.iinfo(np.int64).max)
        better = total < best
        best[better] = total[better]
        chosen[better] = np.stack([places[rows, partner], places[:, i]], axis=1)[better]
    return chosen


def _list_key(codes: np.ndarray, rows: np.ndarray, gram: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit keys of (bigram of ``codes[rows]`` at ``gram``, place, size); what meets is compared, so keys may collide."""
    key = np.zeros(len(rows), np.uint64)
    for part in (codes[rows, gram], codes[rows, gram + 1], place, size):
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


# How many letters longer the other word is, and how much further its bigram may be.
_MOVES = [(0, 0), (1, 0), (1, 1), (-1, -1), (-1, 0)]


def _index(words: DataFrame, order: np.ndarray, least_chars: int) -> DataFrame:
    """Rows of the lists: what a word is found by (side 0), and what it asks for (side 1)."""
    shared = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight = shared.value
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for at, codes in _by_length(batch.column(1)):
                size = codes.shape[1]
                grams = _bucket(codes)
                ranks = place[grams]
                first = np.argsort(ranks, axis=1, kind="stable")[:, :3]
                last = np.take_along_axis(ranks, first[:, 2:], axis=1)
                first.sort(axis=1)
                two = pivots(first, weight[np.take_along_axis(grams, first, axis=1)])
                # A word is found by every bigram up to the last of its prefix, repeated ones too.
                row, gram = np.nonzero(ranks <= last)
                zero = np.zeros(len(row), np.int8)
                parts = [(row, _list_key(codes, row, gram, gram, np.full(len(row), size)), zero, zero, zero, zero)]
                everyone = np.arange(len(at))
                for which in (0, 1):
                    for longer, further in _MOVES:
                        target = two[:, which] + further
                        ok = everyone[(target >= 0) & (target <= size + longer - 2) & (size + longer >= least_chars)]
                        key = _list_key(codes, ok, two[ok, which], target[ok], np.full(len(ok), size + longer))
                        fill = [np.full(len(ok), x, np.int8) for x in (1, longer, which, further)]
                        parts.append((ok, key, *fill))
                rows = np.concatenate([p[0] for p in parts])
                whole = at[rows]
                yield pa.record_batch(
                    [
                        *(pa.array(np.concatenate([p[i] for p in parts])) for i in range(1, 6)),
                        pa.array(numbers[whole]), pa.array(last[rows, 0]), pa.array(two[rows, 0]), pa.array(two[rows, 1]),
                        batch.column(2).take(pa.array(whole)), batch.column(1).take(pa.array(whole)),
                    ],
                    _INDEX_NAMES,
                )

    return words.select("_no", "word", "n").mapInArrow(run, _INDEX)


_INDEX = (
    "_list bigint, _side tinyint, _longer tinyint, _which tinyint, _further tinyint, "
    "_no bigint, _last bigint, _first bigint, _second bigint, n bigint, word string"
)
_INDEX_NAMES = [f.split()[0] for f in _INDEX.split(", ")]


def _blocks(index: DataFrame, block: int) -> DataFrame:
    """Lists with more than ``block`` rows on a side are cut there; every pair of blocks meets in a list of its own."""
    sizes = [F.count_if(F.col("_side") == side) for side in (0, 1)]
    long = (
        index.groupBy("_list").agg(*[F.ceil(s / block).cast("int").alias(f"_n{i}") for i, s in enumerate(sizes)])
        .where("_n0 > 1 OR _n1 > 1")
        .select("_list", F.greatest("_n0", F.lit(1)).alias("_n0"), F.greatest("_n1", F.lit(1)).alias("_n1"))
    )
    if long.isEmpty():
        return index.withColumn("_block", F.lit(0))
    number = lambda side: F.coalesce(f"_n{side}", F.lit(1))
    own = lambda side: F.pmod(F.xxhash64("_no"), number(side)).cast("int")
    other = lambda side: F.sequence(F.lit(0), number(side) - 1)
    return (
        index.join(long, "_list", "left")
        .withColumn("_own", F.when(F.col("_side") == 0, own(0)).otherwise(own(1)))
        .withColumn("_other", F.explode(F.when(F.col("_side") == 0, other(1)).otherwise(other(0))))
        .withColumn("_block", F.when(F.col("_side") == 0, F.col("_own") * number(1) + F.col("_other")).otherwise(
            F.col("_other") * number(1) + F.col("_own")
        ))
        .select(*index.columns, "_block")
    )


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Are the rows of ``a`` and ``b``, of equal length or one letter apart, one edit from each other?"""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    size = a.shape[1]
    if size == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


def _first_meeting(a: np.ndarray, b: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In which of its lists a pair meets first: 2 * pivot + (bigram one further); pairs count there only."""
    longer = b.shape[1] - a.shape[1]
    rows, meets = np.arange(len(a)), np.full(len(a), 9)
    for which in (1, 0):
        for further in sorted((f for x, f in _MOVES if x == longer), reverse=True):
            at = two[:, which]
            to = np.clip(at + further, 0, b.shape[1] - 2)
            same = (to == at + further) & (b[rows, to] == a[rows, at]) & (b[rows, to + 1] == a[rows, at + 1])
            meets[same] = 2 * which + (further != min(longer, 0))
    return meets


def _marks(codes: np.ndarray) -> np.ndarray:
    """Which letters a word has, as 64 bits."""
    return np.bitwise_or.reduce(np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), axis=1)


def _list_pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words of one list: who asked, and who was found."""
    column = {name: rows.column(name).to_numpy() for name in ("_side", "_longer", "_which", "_further", "_no", "_last", "_first", "_second")}
    texts = rows.column("word").combine_chunks()
    found = np.flatnonzero(column["_side"] == 0)
    asking = np.flatnonzero(column["_side"] == 1)
    if not len(found) or not len(asking):
        return
    lengths = np.fromiter(map(len, texts.take(pa.array(found)).to_pylist()), np.int64, len(found))
    two = np.stack([column["_first"], column["_second"]], axis=1)
    meeting = 2 * column["_which"] + (column["_further"] != np.minimum(column["_longer"], 0))
    # Lists are of one length but for keys that collide.
    for size in np.unique(lengths):
        there = found[lengths == size]
        codes = _codes(texts.take(pa.array(there)), int(size))
        marks, last, number = _marks(codes), column["_last"][there], column["_no"][there]
        for longer in (0, 1, -1):
            some = asking[column["_longer"][asking] == longer]
            some = some[np.fromiter((len(t) == size - longer for t in texts.take(pa.array(some)).to_pylist()), bool, len(some))]
            if not len(some):
                continue
            own = _codes(texts.take(pa.array(some)), int(size) - longer)
            own_marks, own_last, own_number = _marks(own), column["_last"][some], column["_no"][some]
            step = max(1, CELLS // len(there))
            for start in range(0, len(some), step):
                part = slice(start, start + step)
                alike = np.bitwise_count(own_marks[part, None] ^ marks[None, :]) <= (1 if longer else 2)
                i, j = np.nonzero(alike)
                i += start
                # The word whose prefix ends earlier asks; if they end alike, the one with the smaller number.
                asks = (own_last[i] < last[j]) | ((own_last[i] == last[j]) & (own_number[i] < number[j]))
                i, j = i[asks], j[asks]
                near = _one_edit(own[i], codes[j])
                i, j = i[near], j[near]
                here = _first_meeting(own[i], codes[j], two[some[i]]) == meeting[some[i]]
                if here.any():
                    yield some[i[here]], there[j[here]]


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n): every ordered pair of different words of (word, n) that are one edit apart, once.

    An edit is one code point inserted, deleted or replaced. Words are
    distinct and of ``least_chars`` code points or more, at least four: a
    shorter one need not have two bigrams without a common letter. Lists with
    more than ``block`` words on a side are cut into blocks that all meet, so
    no task holds more than two blocks, and only near words leave a task.
    """
    if least_chars < 4:
        raise ValueError("two bigrams without a common letter need four letters")
    scratch = Scratch(words.sparkSession, "spelling")
    words, _ = scratch.save(words.where(F.char_length("word") >= least_chars).select(F.monotonically_increasing_id().alias("_no"), "word", "n"))
    index, _ = scratch.save(_index(words, gram_order(words), least_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches):
            lists, blocks = table.column("_list").to_numpy(), table.column("_block").to_numpy()
            cuts = np.flatnonzero((lists[1:] != lists[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, table.num_rows]):
                rows = table.slice(start, end - start).combine_chunks()
                for pairs in _list_pairs(rows):
                    a, b = (rows.select(["word", "n"]).take(pa.array(p)) for p in pairs)
                    for one, other in ((a, b), (b, a)):
                        both = pa.table([one.column(0), other.column(0), other.column(1)], names=["word", "other", "other_n"])
                        yield from both.combine_chunks().to_batches()

    blocks = _blocks(index, block)
    return (
        blocks.select("_list", "_block", *_INDEX_NAMES[1:])
        .repartition("_list", "_block")
        .sortWithinPartitions("_list", "_block", "_side")
        .mapInArrow(run, "word string, other string, other_n bigint")
    )


def spelling_variants(words: DataFrame, least_chars: int = LEAST_CHARS, ratio: int = 2, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of (word, n), and the word it is a variant of.

    A word's form is its most frequent near word, of equals the first in
    code-point order, if that occurs ``ratio`` times as often or more, at
    least twice; its root is where following forms ends. Counts rise along a
    chain by that ratio, so a chain is no longer than the logarithm of the
    largest count, and following it by doubling takes a few rounds, each a
    written table.

    An empty table gives an empty table; a word without near words is its own
    root. Other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("chains of forms end only if counts rise")
    scratch = Scratch(words.sparkSession, "spelling")
    words, _ = scratch.save(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("_less"), "other")).alias("_best")
    near = near_words(words, least_chars, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("_best._less") >= ratio * F.col("n")
    rows, _ = scratch.save(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("_best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, -F.col("_best._less")).alias("form_n"),
        )
    )
    roots, path = scratch.save(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("_via"), F.col("root").alias("_root"))
        moved = roots.join(further, roots["root"] == further["_via"], "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")
        )
        moved, new_path = scratch.save(moved)
        scratch.drop(path)
        roots, path = moved.select("word", "root"), new_path
        if moved.where("_moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
