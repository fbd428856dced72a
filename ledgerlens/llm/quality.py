"""Quality rules: statistics of a text, fixed floors, and an isolation forest.

The forest (Liu, Ting and Zhou, "Isolation Forest", 2008) learns from all labelled
rows: each tree splits its own 256 of the good ones at random until they stand
alone, as the method has it. Texts that are alone after few splits are unlike good
texts. How few is calibrated on the scores of all labelled rows, counted in Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialise

# The symbols of the contract, and what separates words.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]")

# How many rows the trees split, and the digits of a score, which bound how many scores there are to count.
TREES, ROWS_PER_TREE = 100, 256
SCORE_DIGITS = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NOT_CONTINUATION = np.zeros(256, bool)
_NOT_CONTINUATION[[b for b in range(256) if b & 0xC0 != 0x80]] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACE)] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated three-word windows.

    Words stand between ASCII white space. A repeated line holds a word and
    equals an earlier line. A three-word window found twice or more marks its
    words wherever it stands, first time included.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, int(sum(data.count(bytes([s])) for s in SYMBOLS)), 0, 0
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = int(by_byte[_NOT_CONTINUATION & ~_IS_SPACE].sum())
    symbols = int(by_byte[_IS_SYMBOL].sum())
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return len(words), points, symbols, dup_lines, _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    again = np.fromiter((count[w] > 1 for w in windows), bool, len(windows))
    marked = np.zeros(len(words), bool)
    for shift in range(3):
        marked[shift : shift + len(again)] |= again
    return int(marked.sum())


def base_failed(stats: np.ndarray) -> np.ndarray:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def features(stats: np.ndarray) -> np.ndarray:
    """Rates of the statistics, free of the text's length; a text without words gets zeros."""
    s = stats.astype(np.float64)
    words = np.maximum(s[:, 0], 1)
    return np.column_stack([s[:, 1] / words, s[:, 2] / words, s[:, 3] / words, s[:, 4] / words])


@dataclass(frozen=True)
class IsolationForest:
    """Complete binary trees in arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # tree x node; -1 for a leaf
    split: np.ndarray
    length: np.ndarray  # path length that a leaf stands for
    depth: int
    normal: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): higher for shorter paths."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return np.exp2(-total / len(self.feature) / self.normal)


def _average_path(n: int) -> float:
    """Mean depth of a failed search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow_forest(
    x: np.ndarray, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = 7, span: np.ndarray | None = None
) -> IsolationForest:
    """Trees over random rows of ``x``, each split at a random place of a random feature.

    Where ``x`` has rows for all trees, no two share one. A split is drawn from
    the feature's range in the node, widened on both sides by half of ``span``,
    that of all good rows: good texts leave some features at zero throughout,
    and only a split beyond them can set other values apart.
    """
    rng = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    depth = int(np.ceil(np.log2(max(size, 2)))) + 2
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    split = np.zeros((trees, nodes))
    length = np.zeros((trees, nodes))
    spread = np.maximum(np.ptp(x, axis=0) if span is None else span, 0.05) / 2
    dealt = rng.permutation(len(x)) if len(x) >= trees * size else None
    for t in range(trees):
        own = rng.choice(len(x), size, replace=False) if dealt is None else dealt[t * size : (t + 1) * size]
        todo = [(0, 0, x[own], np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf))]
        while todo:
            node, at, part, low, high = todo.pop()
            if at == depth or len(part) < 2:
                length[t, node] = at + _average_path(len(part))
                continue
            f = rng.integers(x.shape[1])
            begin = max(part[:, f].min() - spread[f], low[f])
            end = min(part[:, f].max() + spread[f], high[f])
            s = rng.uniform(begin, end)
            feature[t, node], split[t, node] = f, s
            right = part[:, f] >= s
            below, above = high.copy(), low.copy()
            below[f], above[f] = s, s
            todo.append((2 * node + 1, at + 1, part[~right], low, below))
            todo.append((2 * node + 2, at + 1, part[right], above, high))
    return IsolationForest(feature, split, length, depth, max(_average_path(size), 1.0))


def calibrate(score: np.ndarray, good: np.ndarray, cost: float, rows: np.ndarray | None = None) -> float:
    """The bound on labelled rows beyond which a row is rejected; ``rows`` says how many rows each score stands for.

    It makes the share of bad rows caught less ``cost`` times the share of good
    rows lost as large as it gets, and lies in the middle between the last row
    kept and the first one rejected. Without bad rows nothing is rejected that
    is no worse than all good ones.
    """
    bounds, at = np.unique(score, return_inverse=True)
    rows = np.ones(len(score)) if rows is None else rows

    def above(kind: np.ndarray) -> np.ndarray:
        n = np.bincount(at[kind], rows[kind], len(bounds))
        return 1 - np.cumsum(n) / max(n.sum(), 1)

    gain = above(~good) * bool((~good).any()) - cost * above(good)
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    return float(bounds[best] if best + 1 == len(bounds) else (bounds[best] + bounds[best + 1]) / 2)


@dataclass(frozen=True)
class QualityModel:
    forest: IsolationForest | None
    bound: float

    def anomaly(self, stats: np.ndarray) -> np.ndarray:
        return np.round(self.forest.score(features(stats)), SCORE_DIGITS) if self.forest else np.zeros(len(stats))


def _rows_statistics(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([base_statistics(t) for t in batch.column(column).to_pylist()], np.int64).reshape(-1, 5)


def fit_quality(
    docs: DataFrame, labels: DataFrame, cost: float = 20.0, id_col: str = "doc_id", text_col: str = "text"
) -> QualityModel:
    """Forest and bound from all labelled rows.

    Ids with several labels count as good only if all say so; missing ids and
    labels are ignored. Without good rows that pass the floors there is no
    forest, and only the floors reject. Statistics are taken where the texts
    lie, and only those meet the labels. The driver gets the rows that the
    trees split and a count per score.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in BASE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), *map(pa.array, _rows_statistics(batch, 1).T)], ["_id", *BASE])

    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg((F.min("quality") > 0).alias("_good"))
    )
    measured = docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(measure, f"_id {kind}, {numbers}")
    # Repeated rows count once.
    known = measured.join(chosen, "_id").groupBy("_id").agg(F.min(F.struct(*BASE)).alias("_row"), F.any_value("_good").alias("_good"))
    known = materialise(known.select("_id", "_good", "_row.*").where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words"), "labelled")
    good = known.where("_good")
    # The smallest hashes of all good rows: as many as the trees split.
    drawn = good.orderBy(F.xxhash64(F.lit("tree"), "_id"), "_id").limit(TREES * ROWS_PER_TREE).toArrow().sort_by("_id")
    if not drawn.num_rows:
        return QualityModel(None, np.inf)
    words = F.greatest("n_words", F.lit(1))
    rates = [F.col(c) / words for c in BASE[1:]]
    span = np.array(good.agg(*[F.max(r) - F.min(r) for r in rates]).first())
    stats = lambda rows: np.column_stack([rows.column(c).to_numpy() for c in BASE])
    model = QualityModel(grow_forest(features(stats(drawn)), span=span), np.inf)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = cloudpickle.loads(shared.value)
        for batch in batches:
            anomaly = grown.anomaly(np.column_stack([batch.column(c).to_numpy() for c in BASE]))
            yield pa.record_batch([pa.array(anomaly), batch.column("_good")], ["score", "_good"])

    scored = known.select("_good", *BASE).mapInArrow(score, "score double, _good boolean")
    # A row per score at most, and of those there are 10 ** SCORE_DIGITS.
    found = scored.groupBy("score", "_good").agg(F.count(F.lit(1)).alias("rows")).toArrow()
    at, kept, rows = (found.column(c).to_numpy() for c in ("score", "_good", "rows"))
    return QualityModel(model.forest, calibrate(at, kept.astype(bool), cost, rows))


def judge_quality(
    docs: DataFrame, model: QualityModel, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ``carry`` columns, statistics, base_failed, anomaly, kept) of every row, in one pass without a shuffle.

    ``kept`` is false below the floors, else the forest's verdict. A missing
    text has no words. Repeated rows are each judged alike. An empty table
    gives an empty table. Other columns are ignored.
    """
    # As bytes that carry the class along: workers need no copy of the package to read them.
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    given = docs.select(id_col, text_col, *(c for c in carry if c != text_col))
    names = [id_col, *carry, *BASE, "base_failed", "anomaly", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = cloudpickle.loads(shared.value)
        for batch in batches:
            stats = _rows_statistics(batch, 1)
            failed, anomaly = base_failed(stats), forest.anomaly(stats)
            kept = ~failed & (anomaly <= forest.bound)
            own = [batch.column(batch.schema.get_field_index(c)) for c in (id_col, *carry)]
            yield pa.record_batch([*own, *map(pa.array, stats.T), *map(pa.array, (failed, anomaly, kept))], names)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry)]
    fields += [f"{c} bigint" for c in BASE] + ["base_failed boolean", "anomaly double", "kept boolean"]
    return given.mapInArrow(run, ", ".join(fields))
