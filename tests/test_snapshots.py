import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.session import new_path
from ledgerlens.streaming.snapshots import changed_rows, differing_buckets, write_snapshot

KEYS, VALUES = ("doc_id", "chunk_ord"), ("chunk_text", "file_type")
SCHEMA = "doc_id long, chunk_ord long, chunk_text string, file_type string"


def snapshot(spark, rows, **more):
    path = new_path(spark, "snapshot")
    write_snapshot(spark.createDataFrame(rows, SCHEMA).repartition(3), path, KEYS, VALUES, **more)
    return path


def test_against_a_full_comparison(spark):
    rng = random.Random(1)
    old = {(d, c): (f"text {rng.randrange(5)}", rng.choice(["en", None])) for d in range(200) for c in range(rng.randrange(3))}
    new = dict(old)
    for key in rng.sample(sorted(old), 12):
        if rng.random() < 0.4:
            del new[key]
        else:
            new[key] = (None, old[key][1]) if rng.random() < 0.5 else (old[key][0], "de")
    new |= {(1000 + i, 0): ("new", "en") for i in range(5)}
    expected = {k: "removed" if k not in new else "new" if k not in old else "changed" for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    before, after = (snapshot(spark, [(*k, *v) for k, v in x.items()]) for x in (old, new))
    got = changed_rows(spark, before, after, KEYS, VALUES)
    assert {(r.doc_id, r.chunk_ord): r.status for r in got.collect()} == expected
    buckets = differing_buckets(spark, before, after)
    assert 0 < len(buckets) <= len(expected) and len(buckets) < 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") + plan.count("PartitionFilters: [isnotnull(bucket") >= 2 or "bucket#" in plan


def test_equal_snapshots_read_nothing(spark):
    rows = [(d, 0, f"t{d}", "en") for d in range(50)]
    before, after = snapshot(spark, rows), snapshot(spark, rows[::-1])
    assert differing_buckets(spark, before, after) == []
    assert changed_rows(spark, before, after, KEYS, VALUES).count() == 0


@pytest.mark.parametrize("levels, fanout", [(0, 2), (1, 4), (4, 2)])
def test_shapes_of_trees_and_rows_that_repeat(spark, levels, fanout):
    rows = [(d, 0, "t", "en") for d in range(20)]
    before = snapshot(spark, rows, levels=levels, fanout=fanout)
    after = snapshot(spark, rows[1:] + [(77, 1, None, None)], levels=levels, fanout=fanout)
    got = changed_rows(spark, before, after, KEYS, VALUES, levels, fanout)
    assert sorted(map(tuple, got.collect())) == [(0, 0, "removed"), (77, 1, "new")]
    twice = snapshot(spark, rows + rows[:2], levels=levels, fanout=fanout)
    assert differing_buckets(spark, before, twice, levels, fanout)


def test_empty_snapshots(spark):
    rows = [(1, 0, "t", "en")]
    none, one = snapshot(spark, []), snapshot(spark, rows)
    assert [r.status for r in changed_rows(spark, none, one, KEYS, VALUES).collect()] == ["new"]
    assert [r.status for r in changed_rows(spark, one, none, KEYS, VALUES).collect()] == ["removed"]
    assert changed_rows(spark, none, none, KEYS, VALUES).count() == 0
