from ledgerlens.session import new_path
from ledgerlens.streaming import sync

DOCS = "doc_id long, text string"
FEED = "doc_id long, text string, version long, deleted boolean"


def test_sync_processes_each_file_once(spark):
    source, target, checkpoint = (new_path(spark, n) for n in ("in", "out", "cp"))
    schema = spark.createDataFrame([], DOCS).schema

    def add(*rows):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(source)

    def run():
        sync.sync_chunks(spark, source, schema, target, checkpoint, max_tokens=2)
        rows = spark.read.parquet(target).select("doc_id", "chunk_ord", "chunk_text").collect()
        return sorted(map(tuple, rows))

    add((1, "a b c"), (2, ""), (3, "3 of 4"))
    first = run()
    assert first == [(1, 0, "a b"), (1, 1, "c"), (3, 0, "3 of"), (3, 1, "4")]
    assert run() == first
    add((4, "d"))
    assert run() == first + [(4, 0, "d")]


def test_upsert_keeps_the_newest_version(spark):
    source, target, checkpoint = (new_path(spark, n) for n in ("in", "out", "cp"))
    schema = spark.createDataFrame([], FEED).schema

    def feed(*rows):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(source)
        sync.upsert_chunks(spark, source, schema, target, checkpoint, max_tokens=2)
        out = sync.current_chunks(spark, target).collect()
        return sorted((r.doc_id, r.version, r.chunk_ord, r.chunk_text) for r in out)

    assert feed((1, "a b c", 1, False), (2, "x", 1, False)) == [
        (1, 1, 0, "a b"),
        (1, 1, 1, "c"),
        (2, 1, 0, "x"),
    ]
    # Fewer chunks than before: the old second chunk goes.
    assert feed((1, "z", 3, False)) == [(1, 3, 0, "z"), (2, 1, 0, "x")]
    # An older version arriving late changes nothing; two versions in a batch give the newer.
    assert feed((1, "late", 2, False), (2, "y", 2, False), (2, "yy", 4, False)) == [
        (1, 3, 0, "z"),
        (2, 4, 0, "yy"),
    ]
    # Emptied and deleted documents have no chunks.
    assert feed((1, "", 5, False), (2, None, 5, True)) == []
    assert feed((2, "back", 6, False)) == [(2, 6, 0, "back")]


def test_sync_reads_a_table_that_is_a_folder_or_a_file(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i}") for i in range(9)], DOCS)
    rows.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    single = tmp_path / "one"
    rows.coalesce(1).write.parquet(str(single))
    part = next(p for p in single.iterdir() if p.suffix == ".parquet")
    for path in (tmp_path / "documents.parquet", part):
        target, checkpoint = new_path(spark, "out"), new_path(spark, "cp")
        sync.sync_chunks(spark, str(path), rows.schema, target, checkpoint)
        assert spark.read.parquet(target).count() == 9


def test_ties_of_one_version_are_settled_once(spark):
    source, target, checkpoint = (new_path(spark, n) for n in ("in", "out", "cp"))
    rows = [(1, "a", 1, False), (1, None, 1, True), (2, "x", 1, False), (2, "y", 1, False), (3, "s", 1, False), (3, "s", 1, False)]
    spark.createDataFrame(rows, FEED).repartition(3).write.parquet(source)
    sync.upsert_chunks(spark, source, spark.createDataFrame([], FEED).schema, target, checkpoint)
    larger = spark.range(1).selectExpr("CASE WHEN xxhash64('x') > xxhash64('y') THEN 'x' ELSE 'y' END AS t").first().t
    assert sorted((r.doc_id, r.chunk_text) for r in sync.current_chunks(spark, target).collect()) == [(2, larger), (3, "s")]


def test_compaction_changes_nothing_to_be_seen(spark):
    source, target, checkpoint, compacted = (new_path(spark, n) for n in ("in", "out", "cp", "small"))
    schema = spark.createDataFrame([], FEED).schema
    for version in (1, 2, 3):
        rows = [(i, f"{i} at {version}", version, i % 5 == 0 and version == 3) for i in range(20) if i % version == 0]
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(source)
        sync.upsert_chunks(spark, source, schema, target, checkpoint)
    before = sorted(map(str, sync.current_chunks(spark, target).collect()))
    sync.compact(spark, target, compacted)
    assert sorted(map(str, sync.current_chunks(spark, compacted).select(sync.current_chunks(spark, target).columns).collect())) == before
    assert spark.read.parquet(f"{compacted}/versions").count() == 20
    assert spark.read.parquet(f"{compacted}/chunks").count() < spark.read.parquet(f"{target}/chunks").count()


def test_changed_documents(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], DOCS)
    after = spark.createDataFrame([(2, "b"), (3, "cc"), (4, "d")], DOCS)
    got = dict(map(tuple, sync.changed_documents(before, after).collect()))
    assert got == {1: "removed", 2: "unchanged", 3: "changed", 4: "new"}
