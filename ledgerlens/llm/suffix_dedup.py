"""Removing long repeated byte strings by a distributed merge sort of suffixes.

Every suffix of a corpus is more than can be exchanged, so suffixes are sampled
where repeats must agree. Of the first 150 positions of each 200-byte window
the one with the least hash of its bytes is the window's anchor. Equal windows
have their anchors in the same place, so a repeat is found among the suffixes
that begin at anchors, about one position in seventy-five.

1. Anchors are counted by a hash of the 51 bytes that all windows of an anchor
   share with it; what occurs once goes no further. The *stretch* of an anchor
   is what its windows cover. A stretch that occurs twice is removed whole.
2. What is left are stretches that occur once and share their anchor with
   others: the ends of repeats. Tasks sort the suffixes at these anchors into
   runs, front-coded: a common prefix with the one before is a number. Runs are
   exchanged by ranges of suffixes.
3. Runs are merged by a loser tree that carries common prefixes: of two
   suffixes the one that shares more with the last winner comes first, and only
   where both share as much are bytes compared, from there on. Neighbours with
   long common prefixes and equal bytes before the anchor share windows.

A group of anchors too large for one task is decided by counting hashes of all
its windows instead, which any number of tasks can share.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, below, key_bitmaps, key_runs, with_maybe

WINDOW = 200
REACH = 150  # positions of a window that may be its anchor
SHARED = WINDOW - REACH + 1  # bytes from the anchor on that all its windows hold
GROUP = 4096  # distinct stretches of an anchor that one task resolves
RUN_BYTES = 8 << 20
PER_RANGE = 20_000  # suffixes
MAX_RANGES = 1 << 16  # bounds the splitters that are broadcast to 4 MB
SAMPLE_DOCS = 2_000  # documents that splitters are drawn from

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every anchor, in order."""
    m = len(data) - WINDOW + 1
    if m <= 0:
        return (np.empty(0, np.int64),) * 3
    n = m + REACH - 1
    h = np.ndarray((n,), "<u8", buffer=data, strides=(1,)) * _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    # The hash above, the place below: the least of a window is its leftmost least hash.
    key = np.full(-(-n // REACH) * REACH, np.iinfo(np.uint64).max, np.uint64)
    key[:n] = (h & _HIGH) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, REACH)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:m], before[REACH - 1 : REACH - 1 + m])
    place = (least & ~_HIGH).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], first, np.r_[first[1:], m] - 1


# A stretch's place in one number: first window, bytes before the anchor, further windows, and 16 bits of
# the text's hash, which tell rows of one id apart.
def _pack(tag: int, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (tag << 47) | (first << 16) | ((anchor - first) << 8) | (last - first)


def _unpack(at: int) -> tuple[int, int, int]:
    """(anchor, first window, last window)"""
    first = (at >> 16) & 0x7FFFFFFF
    return first + ((at >> 8) & 0xFF), first, first + (at & 0xFF)


def _tag(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(0xFFFF)


def _shared_hashes(rows: DataFrame) -> DataFrame:
    """(_ctx): the hash of every anchor's shared bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        found: list[int] = []

        def settle() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.array(found, np.uint64).view(np.int64))], ["_ctx"])

        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                found += [digest(data[p : p + SHARED]) for p in anchors(data)[0].tolist()]
                if len(found) > 100_000:
                    yield settle()
                    found = []
        if found:
            yield settle()

    return _compact(rows.select("_data")).mapInArrow(run, "_ctx bigint")


def _compact(rows: DataFrame) -> DataFrame:
    return rows.where(F.octet_length("_data") >= WINDOW)


def _stretches(rows: DataFrame) -> DataFrame:
    """(_ctx, _seg, _id, _at): every anchor with the hash of its stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            at: list[np.ndarray] = []
            row: list[int] = []

            def settle() -> pa.RecordBatch:
                both = np.array(pairs, np.uint64).view(np.int64)
                ids = batch.column(0).take(pa.array(np.repeat(row, list(map(len, at)))))
                columns = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), ids, pa.array(np.concatenate(at))]
                return pa.record_batch(columns, ["_ctx", "_seg", "_id", "_at"])

            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                place, first, last = anchors(data)
                ends = zip(place.tolist(), first.tolist(), last.tolist())
                pairs += [(digest(data[p : p + SHARED]), digest(data[a : b + WINDOW], p - a)) for p, a, b in ends]
                at.append(_pack(batch.column(1)[i].as_py(), place, first, last))
                row.append(i)
                if len(pairs) > 100_000:
                    yield settle()
                    pairs, at, row = [], [], []
            if pairs:
                yield settle()

    kind = rows.schema["_id"].dataType.simpleString()
    return _compact(rows).select("_id", "_tag", "_data").mapInArrow(run, f"_ctx bigint, _seg bigint, _id {kind}, _at bigint")


# --- runs -------------------------------------------------------------------------------------------------

Item = tuple[bytes, bytes, int, int, int]  # suffix from the anchor, bytes before it, ctx, seg, 1 if its stretch occurs once
_HEAD = "<HHHqqB"  # common prefix, further suffix bytes, bytes before, ctx, seg, once


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, which is at least ``start``."""
    most, step = min(len(a), len(b)), 16
    while start + step <= most and a[start : start + step] == b[start : start + step]:
        start += step
    while start < most and a[start] == b[start]:
        start += 1
    return start


def encode_run(items: list[Item]) -> bytes:
    """Sorted items, front-coded and packed."""
    out, last = [], b""
    for suffix, before, ctx, seg, once in items:
        common = _common(last, suffix, 0)
        out += [struct.pack(_HEAD, common, len(suffix) - common, len(before), ctx, seg, once), suffix[common:], before]
        last = suffix
    return zlib.compress(b"".join(out), 1)


def decode_run(run: bytes) -> Iterator[tuple[int, Item]]:
    """(common prefix with the one before, item) in order."""
    data, at, suffix = zlib.decompress(run), 0, b""
    while at < len(data):
        common, more, n_before, ctx, seg, once = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        suffix = suffix[:common] + data[at : at + more]
        at += more
        yield common, (suffix, data[at : at + n_before], ctx, seg, once)
        at += n_before


def merge_runs(runs: list[Iterator[tuple[int, Item]]]) -> Iterator[tuple[int, Item]]:
    """All items in order, each with its common prefix with the one before.

    A loser tree. Each node keeps the loser of its match and the prefix it
    shares with the winner. The next item of the winner's run shares a known
    prefix with the winner as well, so on its way up it is compared to losers
    by these two numbers, and by bytes only beyond them if they are equal.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    current: list[Item | None] = [None] * size

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix with the winner), for prefixes shared with the last item given."""
        if current[a] is None or current[b] is None:
            return (b, lb, a, 0) if current[a] is None else (a, la, b, 0)
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = current[a][0], current[b][0]
        h = _common(x, y, la)
        if x[h : h + 1] < y[h : h + 1] or (len(x) == len(y) == h and current[a][2:4] <= current[b][2:4]):
            return a, la, b, h
        return b, lb, a, h

    for i, run in enumerate(runs):
        current[i] = next(run, (0, None))[1]
    losers: list[tuple[int, int]] = [(0, 0)] * size
    round_ = [(i, 0) for i in range(size)]
    node = size
    while len(round_) > 1:
        node //= 2
        following = []
        for j in range(node):
            w, lw, loser, ll = play(*round_[2 * j], *round_[2 * j + 1])
            losers[node + j] = (loser, ll)
            following.append((w, lw))
        round_ = following
    winner, shared = round_[0]
    while current[winner] is not None:
        yield shared, current[winner]
        shared, current[winner] = next(runs[winner], (0, None))
        node = (size + winner) // 2
        while node:
            winner, shared, loser, ll = play(winner, shared, *losers[node])
            losers[node] = (loser, ll)
            node //= 2


# --- groups -----------------------------------------------------------------------------------------------


def shared_windows(group: list[tuple[int, Item]]) -> list[tuple[int, int, list[int]]]:
    """(ctx, seg, offsets) of the stretches of an anchor that occur once and share windows with others.

    ``group`` is sorted by suffix; each comes with its common prefix with the
    one before. An offset is how far before the anchor a window begins. Two
    stretches share it if they agree in that many bytes before the anchor and
    in the rest of the window from the anchor on; the latter are neighbours.
    """
    # A stretch reaches windows from its bytes before the anchor down to what its suffix allows.
    spans = [(WINDOW - len(item[0]), len(item[1])) for _, item in group]
    found: list[set[int]] = [set() for _ in group]
    if len(group) <= 6:
        for i in range(len(group)):
            prefix = len(group[i][1][0])
            for j in range(i + 1, len(group)):
                prefix = min(prefix, group[j][0])
                if group[i][1][2:4] == group[j][1][2:4]:
                    continue
                low = max(WINDOW - prefix, spans[i][0], spans[j][0])
                high = min(spans[i][1], spans[j][1])
                if low > high:
                    continue
                high = min(high, _common(group[i][1][1][::-1], group[j][1][1][::-1], 0))
                if low <= high:
                    found[i].update(range(low, high + 1))
                    found[j].update(range(low, high + 1))
    else:
        for offset in range(min(s[0] for s in spans), max(s[1] for s in spans) + 1):
            block, first = 0, {}
            for i, (prefix, item) in enumerate(group):
                block += prefix < WINDOW - offset
                if spans[i][0] <= offset <= spans[i][1]:
                    key = (block, item[1][len(item[1]) - offset :])
                    j = first.setdefault(key, i)
                    if j != i and group[j][1][2:4] != item[2:4]:
                        found[i].add(offset)
                        found[j].add(offset)
    return [(item[2], item[3], sorted(f)) for (_, item), f in zip(group, found) if f and item[4]]


def resolve_runs(runs: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """Merge the runs of a range and resolve its groups of equal shared bytes."""
    group: list[tuple[int, Item]] = []
    for prefix, item in merge_runs([decode_run(r) for r in runs]):
        if prefix < SHARED and group:
            yield from shared_windows(group)
            group = []
        group.append((prefix, item))
    yield from shared_windows(group)


# --- the operator -----------------------------------------------------------------------------------------

def _splitters(rows: DataFrame, n: int) -> list[bytes]:
    """Up to ``n - 1`` bounds between ranges of shared bytes, from a bounded sample of documents."""
    if n < 2:
        return []
    # Rows whose hash is below a bound that so many pass: other texts never leave their tasks.
    share = SAMPLE_DOCS / max(1, rows.count())
    sample = _compact(below(rows, share, "_id", "_tag")).select(F.substring("_data", 1, 100_000).alias("_data"))
    seen = sorted({d[p : p + SHARED] for d in sample.toArrow().column(0).to_pylist() for p in anchors(d)[0].tolist()})
    return [seen[len(seen) * i // n] for i in range(1, n)] if seen else []


def _ends_of_repeats(rows: DataFrame, places: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(_ctx, _seg, _offsets) of the places whose windows are shared, by merging sorted runs."""
    bounds = rows.sparkSession.sparkContext.broadcast(_splitters(rows, min(MAX_RANGES, -(-n // PER_RANGE))))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        items: list[Item] = []
        held = 0

        def settle() -> pa.RecordBatch:
            items.sort(key=lambda x: (x[0], x[2], x[3]))
            ranges = [bisect_right(bounds.value, x[0][:SHARED]) for x in items]
            cuts = [i for i in range(len(items)) if not i or ranges[i] != ranges[i - 1]] + [len(items)]
            runs = [(ranges[a], encode_run(items[a:b])) for a, b in zip(cuts, cuts[1:])]
            return pa.record_batch([pa.array([r for r, _ in runs], pa.int32()), pa.array([r for _, r in runs], pa.binary())], ["_range", "_run"])

        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                for p in batch.column(1)[i].as_py():
                    anchor, first, last = _unpack(p["_at"])
                    items.append((data[anchor : last + WINDOW], data[first:anchor], p["_ctx"], p["_seg"], p["_once"]))
                    held += last + WINDOW - first + 200
                if held > RUN_BYTES:
                    yield settle()
                    items, held = [], 0
        if items:
            yield settle()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches):
            keys, runs = table.column(0).to_pylist(), table.column(1).to_pylist()
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                done = list(resolve_runs(runs[a:b]))
                if done:
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["_ctx", "_seg", "_offsets"]
                    )

    runs = _with_texts(rows, places, scratch).mapInArrow(sort, "_range int, _run binary")
    merged = runs.repartition("_range").sortWithinPartitions("_range").mapInArrow(merge, "_ctx bigint, _seg bigint, _offsets array<int>")
    return scratch.save(merged)[0]


def _crowded_repeats(rows: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for anchors with very many stretches, by counting 128-bit hashes of their windows."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, out = batch.column(0)[i].as_py(), []
                for p in batch.column(1)[i].as_py():
                    anchor, first, last = _unpack(p["_at"])
                    for s in range(first, last + 1):
                        out.append((xxhash.xxh3_128_digest(data[s : s + WINDOW]), p["_ctx"], p["_seg"], anchor - s, p["_once"]))
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int8())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], ["_hash", "_ctx", "_seg", "_offset", "_once"])

    schema = "_hash binary, _ctx bigint, _seg bigint, _offset int, _once tinyint"
    windows, _ = scratch.save(_with_texts(rows, places, scratch).mapInArrow(hashes, schema))
    # Repeated rows bring a stretch twice; only different stretches share a window.
    shared, _ = scratch.save(
        windows.groupBy("_hash").agg(F.min("_seg").alias("_a"), F.max("_seg").alias("_b")).where("_a != _b").select("_hash")
    )
    hit = windows.where("_once = 1").join(shared, "_hash", "left_semi")
    return hit.groupBy("_ctx", "_seg").agg(F.collect_set("_offset").alias("_offsets"))


def _with_texts(rows: DataFrame, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(_data, _places): texts with the places of theirs that are asked for. Hardly any others are shuffled."""
    tag = F.shiftrightunsigned("_at", 47).alias("_tag")
    by_row = places.groupBy("_id", tag).agg(
        F.collect_list(F.struct("_ctx", "_seg", "_at", F.col("_once").cast("tinyint").alias("_once"))).alias("_places")
    )
    by_row = by_row.select(F.col("_id").alias("_id2"), F.col("_tag").alias("_tag2"), "_places")
    asked, _ = scratch.save(places.select("_id", tag).distinct())
    some = with_maybe(_compact(rows), key_bitmaps(asked, scratch), "_id", "_tag").where("_maybe")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_tag") == F.col("_tag2"))
    return some.join(by_row, same).select("_data", "_places")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(_id, _tag, _ranges): the byte ranges of every row that repeated windows cover, unsorted and overlapping."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows = docs.select(F.col(id_col).alias("_id"), _tag(F.col(text_col)).alias("_tag"), F.col(text_col).cast("binary").alias("_data"))
    twice, twice_path = scratch.save(
        _shared_hashes(rows).groupBy("_ctx").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_ctx")
    )
    some, some_path = scratch.save(_stretches(rows).join(twice, "_ctx", "left_semi"))
    scratch.drop(twice_path)
    distinct, _ = scratch.save(
        some.groupBy("_ctx", "_seg").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_id", "_at")).alias("_one"))
    )
    several, _ = scratch.save(distinct.where("_n > 1").select("_ctx", "_seg"))
    whole = some.join(several, ["_ctx", "_seg"], "left_semi").select("_id", "_at", F.lit(None).cast("array<int>").alias("_offsets"))

    # Anchors with stretches that differ, one of which at least occurs once: ends of repeats.
    mixed, _ = scratch.save(
        distinct.groupBy("_ctx").agg(F.count(F.lit(1)).alias("_stretches"), F.count_if(F.col("_n") == 1).alias("_singles"))
        .where("_stretches > 1 AND _singles > 0").select("_ctx", "_stretches")
    )
    places, _ = scratch.save(
        distinct.join(mixed, "_ctx").select("_ctx", "_seg", "_one._id", "_one._at", (F.col("_n") == 1).alias("_once"), (F.col("_stretches") > group).alias("_crowded"))
    )
    n = {r[0]: r[1] for r in places.groupBy("_crowded").agg(F.count(F.lit(1))).collect()}
    resolved = _ends_of_repeats(rows, places.where("NOT _crowded"), n.get(False, 0), scratch)
    if n.get(True):
        resolved = resolved.unionByName(_crowded_repeats(rows, places.where("_crowded"), scratch))
    part = places.where("_once").join(resolved, ["_ctx", "_seg"]).select("_id", "_at", "_offsets")
    ranges = whole.unionByName(part).groupBy("_id", F.shiftrightunsigned("_at", 47).alias("_tag"))
    return scratch.save(ranges.agg(F.collect_list(F.struct("_at", "_offsets")).alias("_ranges")))[0]


def covered(n: int, places: list[dict]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that repeated windows cover."""
    step = np.zeros(n + 1, np.int64)
    for p in places:
        anchor, first, last = _unpack(p["_at"])
        if p["_offsets"] is None:
            step[first] += 1
            step[last + WINDOW] -= 1
        else:
            for offset in p["_offsets"]:
                step[anchor - offset] += 1
                step[anchor - offset + WINDOW] -= 1
    inside = np.cumsum(step[:n]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def suffix_dedup(
    docs: DataFrame,
    carry: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    group: int = GROUP,
    decoded: bool = False,
) -> DataFrame:
    """(id, ``carry`` columns, n_bytes, n_removed, n_spans, kept): rows without their repeated bytes.

    A byte goes if a 200-byte string that covers it starts anywhere else as
    well, in another row or the same, overlapping itself or not, judged on the
    texts as given. ``kept`` is binary, as a cut may fall inside a character;
    ``decoded`` makes it text, without the bytes that a cut has broken.
    ``n_spans`` counts maximal runs of removed bytes.

    A missing text is empty. Texts of fewer than 200 bytes lose nothing.
    Repeated rows are repeats of each other. Rows of one id with different
    texts are told apart by 16 bits of a hash of the text. Rows without an id
    are treated like others. An empty table gives an empty table. Other
    columns are ignored unless carried.
    """
    ranges = repeated_ranges(docs, id_col, text_col, group)
    bitmaps = key_bitmaps(ranges.select("_id", "_tag"), Scratch(docs.sparkSession, "suffix-dedup"))
    ranges = ranges.withColumnsRenamed({"_id": "_id2", "_tag": "_tag2"})
    rows = docs.select(
        F.col(id_col).alias("_id"), _tag(F.col(text_col)).alias("_tag"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_data"), *(F.col(c).alias(f"_c_{c}") for c in carry),
    )
    # Texts that surely lose nothing stay where they are.
    rows = with_maybe(rows, bitmaps, "_id", "_tag")
    joined = rows.where("_maybe").join(ranges, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_tag") == F.col("_tag2")), "left")
    joined = joined.unionByName(rows.where("NOT _maybe"), allowMissingColumns=True)
    names = [id_col, *carry, "n_bytes", "n_removed", "n_spans", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string() if decoded else pa.binary())

        def settle(batch: pa.RecordBatch, start: int, out: list[tuple]) -> pa.RecordBatch:
            own = [batch.column(c).slice(start, len(out)) for c in (0, *range(3, 3 + len(carry)))]
            return pa.record_batch([*own, *(pa.array(c, t) for c, t in zip(zip(*out), types))], names)

        for batch in batches:
            start, held, out = 0, 0, []
            for i in range(batch.num_rows):
                data, places = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                spans = covered(len(data), places) if places else []
                cuts = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                out.append((len(data), len(data) - len(kept), len(spans), kept.decode(errors="ignore") if decoded else kept))
                held += len(kept)
                if held > 1 << 22:
                    yield settle(batch, start, out)
                    start, held, out = i + 1, 0, []
            if out:
                yield settle(batch, start, out)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry)]
    fields += ["n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept string" if decoded else "kept binary"]
    return joined.select("_id", "_data", "_ranges", *(f"_c_{c}" for c in carry)).mapInArrow(cut, ", ".join(fields))
