"""Resharding with the fewest moved bytes: a minimum-cost flow between shard totals, then block transfers.

Only totals per shard reach the driver. There a flow from old shards to new
capacities says how many bytes go from each old shard to each new one; staying
costs nothing, moving costs one per byte. In every old shard the documents lie
on an axis of bytes, in hashed blocks of bounded size whose starts are running
sums; the flow cuts the axis into intervals, and a document goes where its
first byte falls.

A cut misses its place by up to half a document. So documents are dealt in
three classes of falling size: the loads of a class are measured, and the next
flow deals the smaller ones into what is left. Shards end up equal within a few
of the smallest documents, which hold a hundredth of the bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

BLOCK_BYTES = 16 << 20
SHARES = (0.1, 0.01)  # of the bytes: what documents up to a class bound hold
_BLOCK = ("_old", "_class", "_block")


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int]) -> list[list[int]]:
    """``flow[i][j]`` from sources to sinks that ships all supply at the least cost.

    Shortest augmenting paths in the residual graph, found by Bellman and
    Ford; each fills a source, a sink or a back edge. The graph has one node
    per shard. Capacities must hold all supply.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Distances from all sources with supply; sinks follow the sources in the numbering.
        best = [0 if x else None for x in left] + [None] * m
        parent: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if best[i] is not None and (best[n + j] is None or best[i] + cost(i, j) < best[n + j]):
                        best[n + j], parent[n + j], changed = best[i] + cost(i, j), i, True
                    if flow[i][j] and best[n + j] is not None and (best[i] is None or best[n + j] - cost(i, j) < best[i]):
                        best[i], parent[i], changed = best[n + j] - cost(i, j), n + j, True
        sink = min((j for j in range(m) if room[j] and best[n + j] is not None), key=lambda j: (best[n + j], j))
        path = [n + sink]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        amount = min(left[path[0]], room[sink], *(flow[b][a - n] for a, b in steps if a >= n))
        for a, b in steps:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[sink] -= amount
    return flow


def _bound(sizes: dict[tuple, int], least: float) -> int:
    """The length in bits up to which documents hold at least ``least`` bytes."""
    bound, below = 0, 0
    for bound in sorted({k for _, k in sizes}):
        below += sum(v for (_, k), v in sizes.items() if k == bound)
        if below >= least:
            break
    return bound


def _moved(i: int, j: int) -> int:
    return int(i != j)


def even_capacities(total: int, n: int) -> list[int]:
    return [total * (j + 1) // n - total * j // n for j in range(n)]


@dataclass(frozen=True)
class Resharding:
    """Where every document goes, and which shards have to be written anew."""

    placed: DataFrame  # id, text, carried columns, size, old_shard, shard, slot
    flow: list[list[int]]  # bytes planned from old to new
    moved: list[list[int]]  # bytes that go
    affected: list[int]  # shards that lose or gain a document

    def write(self, path: str) -> None:
        """Rewrite the affected shards under ``path`` as folders ``shard=N``; the others are left alone."""
        rows = self.placed.where(F.col("shard").isin(self.affected)) if self.affected else self.placed.limit(0)
        rows.write.mode("append").partitionBy("shard").parquet(path)


def _by_key(values: dict[tuple, list | int], pick: Callable[[object], Column]) -> Column:
    """One expression per (old shard, class); there are few."""
    cases = [((F.col("_old") == old) & (F.col("_class") == kind), pick(v)) for (old, kind), v in values.items()]
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), cases, F.lit(None))


def _interval(parts: list[tuple[int, int]]) -> Column:
    """The target whose interval of the byte axis holds ``_at``; the last one has what is left over."""
    ends, total = [], 0
    for target, amount in parts:
        total += amount
        ends.append((target, total))
    out = F.lit(ends[-1][0])
    for target, end in reversed(ends[:-1]):
        out = F.when(F.col("_at") < end, F.lit(target)).otherwise(out)
    return out


def _parts(old: int, flow: list[int]) -> list[tuple[int, int]]:
    """What stays comes first, then the others in order."""
    some = [(j, x) for j, x in enumerate(flow) if x] or [(min(old, len(flow) - 1), 0)]
    return sorted(some, key=lambda p: (p[0] != old, p[0]))


def reshard(
    docs: DataFrame,
    old_shard: Column,
    n_old: int,
    capacities: Callable[[int], list[int]],
    carry: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Resharding:
    """Move documents from old shards 0..n_old-1 to new ones with the given capacities.

    ``capacities`` gets the total size and returns one number per new shard,
    in bytes; a shard number that is in both is the same shard. A document's
    size is its text's UTF-8 bytes plus 1; a missing text counts 1. Slots
    number the documents of a shard from 0 without gaps.

    Texts are shuffled once, by block; blocks hold about ``block_bytes``.
    Repeated rows get slots of their own. A shard that was empty stays so if
    nothing goes there; an empty table gives an empty table. Documents
    without an id are placed like others. Other columns are left out unless
    carried.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("bigint")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c_{c}") for c in carry),
        size.alias("_size"), old_shard.cast("int").alias("_old"), F.xxhash64(id_col, text_col).alias("_h"),
    )
    log = F.length(F.bin("_size"))
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("_old", log.alias("_log")).agg(F.sum("_size")).collect()}
    total = sum(sizes.values())
    new = capacities(total)
    supply = [sum(v for (o, _), v in sizes.items() if o == i) for i in range(n_old)]
    flow = min_cost_flow(supply, new, _moved)

    # Classes by size, cut at powers of two: 0 is large, the last one holds the smallest documents.
    bounds = [_bound(sizes, share * total) for share in SHARES]
    of_log = lambda k: sum(k <= x for x in bounds)
    classes = range(len(bounds) + 1)
    held = {(i, c): sum(v for (o, k), v in sizes.items() if o == i and of_log(k) == c) for i in range(n_old) for c in classes}
    n_blocks = _by_key({k: -(-v // block_bytes) or 1 for k, v in held.items()}, F.lit)
    blocked = rows.withColumn("_class", sum(((log <= x).cast("int") for x in bounds), F.lit(0)))
    blocked = blocked.withColumn("_block", F.pmod("_h", n_blocks.cast("bigint")).cast("int"))

    # The byte axis: starts of blocks are running sums of their sizes, starts of documents go on from there.
    in_block = Window.partitionBy(*_BLOCK).orderBy("_h", "_id", "_size")
    narrow = blocked.drop("_text", *(f"_c_{c}" for c in carry))
    axis = Window.partitionBy("_old", "_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks, _ = scratch.save(
        narrow.groupBy(*_BLOCK).agg(F.sum("_size").alias("_bytes"))
        .withColumn("_start", F.coalesce(F.sum("_bytes").over(axis), F.lit(0))).drop("_bytes")
    )
    running = F.sum("_size").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    # A document lies where its middle does, so cuts miss by half a document at most, either way.
    at = (F.col("_start") + running - F.ceil(F.col("_size") / 2)).cast("bigint").alias("_at")
    placed, placed_path = scratch.save(narrow.join(blocks, list(_BLOCK)).select(*_BLOCK, "_size", at))

    # Class by class: a flow into what the classes before have left, for its share of the room.
    cuts: dict[tuple, list] = {}
    moved = [[0] * len(new) for _ in range(n_old)]
    for c in classes:
        own, rest = [held[i, c] for i in range(n_old)], sum(held[i, d] for i in range(n_old) for d in classes if d >= c)
        room = [max(0, x - sum(m[j] for m in moved)) for j, x in enumerate(new)]
        # The plan for all that is left; room may fall short by what was overshot, which is shared out.
        room = [r + x for r, x in zip(room, even_capacities(max(0, rest - sum(room)), len(new)))]
        left = [sum(held[i, d] for d in classes if d >= c) for i in range(n_old)]
        plan = min_cost_flow(left, room, _moved)
        cuts |= {(i, c): [(j, x * own[i] // max(left[i], 1)) for j, x in _parts(i, plan[i])] for i in range(n_old)}
        here = placed.where(F.col("_class") == c).withColumn("_to", _by_key({k: v for k, v in cuts.items() if k[1] == c}, _interval))
        for r in here.groupBy("_old", "_to").agg(F.sum("_size")).collect():
            moved[r[0]][r[1]] += r[2]
    target = _by_key(cuts, _interval).cast("int")

    # Slots: rows per block and target, summed along each target; a block's targets follow each other.
    along = Window.partitionBy("_to").orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*_BLOCK).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    units = (
        placed.withColumn("_to", target).groupBy(*_BLOCK, "_to")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    )
    units, units_path = scratch.save(
        units.withColumn("_slot", F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    )
    scratch.drop(placed_path)
    slots, _ = scratch.save(
        units.groupBy(*_BLOCK).agg(F.map_from_entries(F.collect_list(F.struct("_to", "_slot"))).alias("_slots")).join(blocks, list(_BLOCK))
    )
    scratch.drop(units_path)
    out = (
        blocked.join(slots, list(_BLOCK))
        .withColumns({"_at": at, "_n": F.row_number().over(in_block)})
        .withColumn("_to", target)
        .select(
            F.col("_id").alias(id_col), F.col("_text").alias(text_col), *(F.col(f"_c_{c}").alias(c) for c in carry),
            F.col("_size").alias("size"), F.col("_old").alias("old_shard"), F.col("_to").alias("shard"),
            (F.element_at("_slots", F.col("_to")) + F.col("_n") - 1).cast("bigint").alias("slot"),
        )
    )
    gone = [sum(m) - m[i] if i < len(new) else sum(m) for i, m in enumerate(moved)]
    come = [sum(m[j] for i, m in enumerate(moved) if i != j) for j in range(len(new))]
    affected = [j for j in range(len(new)) if come[j] or (j < n_old and gone[j])]
    return Resharding(out, flow, moved, affected)
