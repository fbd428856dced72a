"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 4 bits differ in at most 4 bytes, so at least 4
of their 8 bytes agree in place. The index lists fingerprints by the bytes they
hold at certain positions. Lists of a single byte would hold 1/256 of the
corpus each; instead a list is named by three positions and their bytes. The
twenty triples of Turan's construction are such that every four positions
contain one of them, so every pair that agrees in four bytes meets in a list.
Inside a list the agreeing bytes of a pair are tallied, pairs with fewer than
four are dropped, and the rest are verified bit by bit.

Lists give spanning forests, not pairs: a list of n fingerprints sends out at
most n - 1 links, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, key_runs
from ledgerlens.llm.components import connected_components

WORDS_PER_SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK = 32768  # fingerprints of a list that meet in one task

# Row b holds the eight bits of byte b, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def position_triples() -> list[tuple[int, int, int]]:
    """The fewest triples of the eight byte positions that hit every four of them.

    Turan: in three groups of near-equal size, the triples inside a group, and
    those with two positions in a group and the third in the next one.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    return [
        t
        for t in combinations(range(8), 3)
        if len(in_group := {group[p] for p in t}) == 1
        or (
            len(in_group) == 2
            and (pair := next(g for g in in_group if sum(group[p] == g for p in t) == 2)) is not None
            and (in_group - {pair}).pop() == (pair + 1) % 3
        )
    ]


def fingerprint(text: str | None, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 if it has no word.

    A-Z are folded; words are what stands between the six ASCII white-space
    characters, just as ``bytes.lower`` and ``bytes.split`` see them.
    """
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(cuts) < words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(cuts[: len(cuts) - words_per_shingle + 1] + 1).tolist()]
        ends = [*cuts[words_per_shingle - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends)]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, p], minlength=256) @ _BITS for p in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row; a missing text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64())], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _near(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification, of XORed fingerprints."""
    alike = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits
    alike[alike] = np.bitwise_count(x[alike]) <= max_bits
    return alike


def _forest(prints: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that span the components of a long list, by breadth-first search.

    What has been reached is compared no more, so a dense cluster costs about
    its size and only fingerprints without links meet all others.
    """
    left, right, rest = [], [], prints
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            here = frontier.pop()
            hit = _near(rest ^ here, max_bits)
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), here))
                right.append(found)
                frontier.extend(found)
                rest = rest[~hit]
    return left, right


def _list_links(keys: np.ndarray, prints: np.ndarray, max_bits: int, short: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the lists of a sorted table: short lists all at once, long ones one by one."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    size_of_row = np.repeat(sizes, sizes)
    few = np.flatnonzero((size_of_row > 1) & (size_of_row <= short))
    k, p = keys[few], prints[few]
    for step in range(1, short):
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.empty(0, np.int64)
        if not len(same):
            break
        hit = same[_near(p[same] ^ p[same + step], max_bits)]
        left.append(p[hit])
        right.append(p[hit + step])
    for i in np.flatnonzero(sizes > short):
        more = _forest(prints[starts[i] : starts[i] + sizes[i]], max_bits)
        left += more[0]
        right += more[1]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that keep all components within ``max_bits``.

    ``max_bits`` is 4 or less. A list of more than ``block`` fingerprints is
    cut into blocks by their hash, and each pair of blocks meets in a task of
    its own, so no task holds more than two blocks of a list.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the position triples hold for up to 4 differing bits")
    octet = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(8)]
    names = [
        (F.lit(j << 24) + F.shiftleft(octet[a], 16) + F.shiftleft(octet[b], 8) + octet[c]).cast("int")
        for j, (a, b, c) in enumerate(position_triples())
    ]
    index = prints.select(F.explode(F.array(*names)).alias("_list"), "fp")
    long = index.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    if long.isEmpty():
        index = index.withColumn("_pair", F.lit(0))
    else:
        blocks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
        # A block meets itself and every other block, as the smaller or the larger of the two.
        pair = F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other")
        index = (
            index.join(long, "_list", "left")
            .withColumn("_blocks", blocks)
            .withColumn("_own", own)
            .select("_list", "fp", "_own", "_blocks", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
            .select("_list", "fp", pair.cast("int").alias("_pair"))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches):
            found = _list_links(
                rows.column(0).to_numpy(), rows.column(1).to_numpy().view(np.uint64).copy(), max_bits
            )
            if len(found[0]):
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

    return (
        index.select((F.col("_list").cast("bigint") * (1 << 31) + F.col("_pair")).alias("_key"), "fp")
        .repartition("_key")
        .sortWithinPartitions("_key", "fp")
        .mapInArrow(run, "a bigint, b bigint")
    )


def simhash_components(
    docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id linked to it.

    Links are fingerprints within ``max_bits`` bits; equal fingerprints are
    linked, zero (no words: missing, empty and blank texts) like any other.
    Copies collapse to their fingerprint before anything is compared.

    Rows without an id get a component as well; its id is the smallest that
    is present, or missing if none is. Repeated rows are each returned. An
    empty table gives an empty table. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, _ = scratch.save(fingerprints(docs, id_col, text_col))
    nodes, _ = scratch.save(rows.groupBy("fp").agg(F.min(id_col).alias("_least")))
    roots = connected_components(near_links(nodes.select("fp"), max_bits, block), "a", "b")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root")
    )
    # A component's smallest id goes back to its fingerprints, and from there to the rows.
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "_root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(id_col, "fp", "component_id")
