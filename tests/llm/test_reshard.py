"""Resharding: the law, the slots, the fewest bytes moved, and the files left alone."""

import itertools
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import queries
from ledgerlens.llm.reshard import even_capacities, min_cost_flow, reshard
from ledgerlens.session import new_path


def least_cost(supply, capacity, cost):
    """All ways to deal small supplies, unit by unit."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    best = None
    for deal in itertools.product(range(len(capacity)), repeat=len(units)):
        if all(deal.count(j) <= c for j, c in enumerate(capacity)):
            total = sum(cost(i, j) for i, j in zip(units, deal))
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("supply, capacity", [([3, 1, 0], [1, 2, 1]), ([4], [1, 1, 2]), ([2, 2], [4]), ([0, 0], [0, 1]), ([1, 2, 2], [2, 2, 2])])
@pytest.mark.parametrize("cost", [lambda i, j: int(i != j), lambda i, j: (3 * i + 5 * j) % 7, lambda i, j: abs(i - j)])
def test_flow_is_cheapest(supply, capacity, cost):
    flow = min_cost_flow(supply, capacity, cost)
    assert [sum(row) for row in flow] == supply
    assert all(sum(column) <= c for column, c in zip(zip(*flow), capacity))
    assert sum(x * cost(i, j) for i, row in enumerate(flow) for j, x in enumerate(row)) == least_cost(supply, capacity, cost)


def test_flow_refuses_too_little_room():
    with pytest.raises(ValueError):
        min_cost_flow([3], [1, 1], lambda i, j: 0)


def check(rows, n, texts):
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in texts), key=str)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    for some in by_shard.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    return {s: sum(r["size"] for r in some) for s, some in by_shard.items()}


def test_query_over_whole_documents(spark, data):
    texts = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op4_reshard(spark, data).collect()
    loads = check(rows, 8, texts)
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    assert all((r["size"], r["text_crc32"]) == size[r["doc_id"]] for r in rows)
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 0.03 * sum(loads.values()) / 8


@pytest.mark.parametrize("block_bytes", [1 << 24, 5000])
def test_moves_hardly_more_than_the_flow(spark, data, block_bytes):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    old = F.pmod("doc_id", F.lit(3))
    done = reshard(docs, old, 3, lambda total: even_capacities(total, 5), ("lang",), block_bytes)
    planned, moved = (sum(x for i, row in enumerate(m) for j, x in enumerate(row) if i != j) for m in (done.flow, done.moved))
    total = sum(map(sum, done.moved))
    assert planned == total - sum(min(sum(done.flow[i]), even_capacities(total, 5)[i]) for i in range(3))
    assert abs(moved - planned) <= 0.02 * total
    assert "lang" in done.placed.columns
    again = {tuple(r) for r in done.placed.select("doc_id", "shard", "slot").collect()}
    assert again == {tuple(r) for r in done.placed.select("doc_id", "shard", "slot").collect()}


def test_shards_that_neither_gain_nor_lose_are_left_alone(spark):
    docs = spark.createDataFrame([(i, "x" * 99) for i in range(60)], "doc_id bigint, text string")
    old = F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 30, 1).otherwise(2)
    done = reshard(docs, old, 3, lambda total: [1000, 2500, 2500])
    assert done.affected == [1, 2]
    path = new_path(spark, "shards")
    done.write(path)
    assert {r[0] for r in spark.read.parquet(path).select("shard").distinct().collect()} == {1, 2}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (3, "é" * 1000), (None, "a"), (4, "b" * 2_000_000), (None, None)] + [(9, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"_old": F.lit("x"), "shard": F.lit(9), "_at": F.lit(0)})
    done = reshard(docs, F.lit(0), 1, lambda total: even_capacities(total, 3))
    check(done.placed.collect(), 3, rows)
    empty = reshard(docs.limit(0), F.lit(0), 1, lambda total: even_capacities(total, 3))
    assert empty.placed.count() == 0 and empty.affected == []
