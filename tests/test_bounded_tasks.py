"""More input gives more tasks, not larger ones."""

import pytest

from ledgerlens.plans import standins
from ledgerlens.session import tune


@pytest.fixture
def small(spark):
    """Two partitions of the session's own, and a bound on what a task reads of 4 KB."""
    settings = {
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    tune(spark)
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("table", [standins.ctr_reporting, standins.str_filing])
def test_line_tables_are_cut_by_size(small, data, table):
    assert table(small, data).rdd.getNumPartitions() > 2


def test_a_bound_is_set_whatever_the_session_has(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1GB")
    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"


def test_one_csv_file_is_not_made_by_one_task(small, tmp_path):
    """The table behind a file is made by several tasks; only its rows come together."""

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        for batch in batches:
            yield pa.record_batch([pa.array([TaskContext.get().stageId()] * batch.num_rows, pa.int64()), pa.array([TaskContext.get().partitionId()] * batch.num_rows, pa.int64())], ["stage", "part"])

    standins.csv_folder({"a.csv": small.range(0, 1000, 1, 4).mapInArrow(task, "stage bigint, part bigint")}, f"file://{tmp_path}/csv")
    rows = [line.strip().split(",") for line in open(tmp_path / "csv/a.csv")][1:]
    assert len(rows) == 1000 and len({r[1] for r in rows}) == 4
