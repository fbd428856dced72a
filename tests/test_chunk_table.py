"""The chunk table that is reloaded source by source, its feed, and an index that follows it."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.schemas import CHUNKS
from ledgerlens.session import new_path
from ledgerlens.sources.chunk_store import with_chunk_id
from ledgerlens.sources.chunk_table import AFTER, BEFORE, DELETE, INSERT, ChunkTable, CommitConflict
from ledgerlens.streaming import feed


def chunks(spark, texts):
    """{source: [chunk texts]}"""
    rows = [(s, "en", i, t, 1) for s, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "source_file string, file_type string, chunk_ord long, chunk_text string, n_tokens long")
    return with_chunk_id(df, "source_file").select(*CHUNKS.names)


def state(df):
    out = {}
    for r in df.select("source_file", "chunk_ord", "chunk_text").orderBy("source_file", "chunk_ord").collect():
        out.setdefault(r.source_file, []).append(r.chunk_text)
    return out


def sources(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "source_file string")


def files(path):
    """Data files with their size and time."""
    found = {}
    for folder, _, names in os.walk(path.removeprefix("file:") + "/data"):
        for n in names:
            if n.endswith(".parquet"):
                s = os.stat(f"{folder}/{n}")
                found[f"{folder}/{n}"] = s.st_size, s.st_mtime_ns
    return found


START = {"a": ["a0", "a1"], "b": ["b0"], "c": ["c0", "c1", "c2"]}


@pytest.fixture
def table(spark):
    t = ChunkTable(spark, new_path(spark, "chunk-table"), slots=4)
    assert t.version() == 0 and state(t.scan()) == {}
    assert t.commit(chunks(spark, START)) == 1
    return t


def test_one_source_is_loaded_again_and_the_files_of_others_stay(spark, table):
    before = files(table.path)
    assert table.commit(chunks(spark, {"b": ["b0 new", "b1"]})) == 2
    assert state(table.scan()) == START | {"b": ["b0 new", "b1"]}
    assert before.items() <= files(table.path).items()
    # Older versions are still there for their readers.
    assert state(table.scan(1)) == START


def test_sources_without_chunks_are_removed_and_come_back(spark, table):
    table.commit(chunks(spark, {"c": ["again"]}), sources(spark, "a", "c", "unknown"))
    assert state(table.scan()) == {"b": ["b0"], "c": ["again"]}
    table.commit(chunks(spark, {"a": ["back"]}))
    assert state(table.scan()) == {"a": ["back"], "b": ["b0"], "c": ["again"]}
    assert [(r.change, r.chunk_text) for r in table.changes(3).collect()] == [(INSERT, "back")]


def test_chunks_of_sources_that_are_not_named_are_not_loaded(spark, table):
    table.commit(chunks(spark, {"a": ["x"], "b": ["y"]}), sources(spark, "a"))
    assert state(table.scan()) == START | {"a": ["x"]}


def test_changes_have_both_images(spark, table):
    table.commit(chunks(spark, {"c": ["c0", "other"], "d": ["d0"]}))
    got = sorted((r.change, r.source_file, r.chunk_ord, r.chunk_text, r.version) for r in table.changes(2).collect())
    assert got == sorted([(BEFORE, "c", 1, "c1", 2), (AFTER, "c", 1, "other", 2), (DELETE, "c", 2, "c2", 2), (INSERT, "d", 0, "d0", 2)])
    assert {(r.change, r.source_file) for r in table.changes(1).collect()} == {(INSERT, s) for s in START}


def test_replaying_the_feed_gives_the_table(spark, table):
    steps = [({"a": ["a0", "A1", "a2"]}, None), ({}, ("b",)), ({"b": ["new b"], "e": ["e0"]}, ("b", "e", "c")), ({"a": []}, ("a",)), ({"a": ["end"]}, None)]
    for texts, named in steps:
        table.commit(chunks(spark, texts | {"_": []}), sources(spark, *named) if named else None)
        assert state(feed.replayed(table)) == state(table.scan())
    table.compact()
    assert state(feed.replayed(table)) == state(table.scan())


def test_an_index_follows_with_an_offset_of_its_own(spark, table):
    target, checkpoint = new_path(spark, "index"), new_path(spark, "offsets")
    feed.sync_index(table, target, checkpoint)
    assert state(feed.current_index(spark, target)) == START
    written = files_under(target)
    feed.sync_index(table, target, checkpoint)
    assert files_under(target) == written
    table.commit(chunks(spark, {"b": ["b0", "b1"], "c": ["C"]}))
    table.commit(chunks(spark, {}), sources(spark, "a"))
    feed.sync_index(table, target, checkpoint)
    got = feed.current_index(spark, target)
    assert state(got) == state(table.scan()) == {"b": ["b0", "b1"], "c": ["C"]}
    assert {(r.chunk_text, r.version) for r in got.collect()} == {("b0", 1), ("b1", 2), ("C", 2)}
    # Another index starts from the beginning, a commit at a time.
    late, own = new_path(spark, "index"), new_path(spark, "offsets")
    feed.sync_index(table, late, own, per_batch=1)
    assert state(feed.current_index(spark, late)) == state(got)
    # Unchanged rows were not written again.
    assert spark.read.parquet(target).where("NOT deleted AND source_file = 'b' AND chunk_ord = 0").count() == 1


def files_under(path):
    return sorted(f"{d}/{n}" for d, _, names in os.walk(path.removeprefix("file:")) for n in names)


def test_a_failed_commit_is_not_seen_and_can_be_run_again(spark, table, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(ChunkTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.commit(chunks(spark, {"a": ["half"]}))
    assert table.version() == 1 and state(table.scan()) == START
    assert table.commit(chunks(spark, {"a": ["whole"]})) == 2 and state(table.scan())["a"] == ["whole"]


def test_the_second_writer_of_a_version_is_refused(spark, table, monkeypatch):
    monkeypatch.setattr(ChunkTable, "version", lambda self: 0)
    with pytest.raises(CommitConflict):
        table.commit(chunks(spark, {"z": ["late"]}))
    monkeypatch.undo()
    assert table.version() == 1


def test_compaction_and_vacuum(spark, table):
    table.commit(chunks(spark, {"a": ["x"]}))
    table.commit(chunks(spark, {}), sources(spark, "b"))
    now = state(table.scan())
    assert table.compact() == 4 and state(table.scan()) == now
    assert table.changes(4).count() == 0
    assert table.vacuum() == [1, 2, 3] and table.versions() == [4]
    assert state(table.scan()) == now
    table.commit(chunks(spark, {"n": ["n0"]}))
    assert state(table.scan()) == now | {"n": ["n0"]}


def test_only_slots_of_reloaded_sources_are_read(spark, table):
    rows = table._live(1, sources(spark, "b"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot" in plan.split("PartitionFilters")[1][:80]


def test_many_names_are_joined_without_a_broadcast(spark, table, monkeypatch):
    monkeypatch.setattr("ledgerlens.sources.chunk_table.BROADCAST_BYTES", 0)
    table.commit(chunks(spark, {"b": ["b0", "b1"]}))
    assert state(table.scan()) == START | {"b": ["b0", "b1"]}
    assert table.changes(2).select("change", "chunk_text").collect() == [(INSERT, "b1")]


def test_the_table_of_another_schema(spark):
    rows = spark.createDataFrame([(1, "s", 0.5), (2, "t", None)], "nr long, part string, x double")
    table = ChunkTable(spark, new_path(spark, "other"), "part", "nr", rows.schema)
    table.commit(rows)
    table.commit(rows.where("nr = 2").withColumn("x", F.lit(2.0)))
    assert sorted(map(tuple, table.scan().collect())) == [(1, "s", 0.5), (2, "t", 2.0)]
    assert {r.change for r in table.changes(2).collect()} == {BEFORE, AFTER}
