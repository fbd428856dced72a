"""CSV folders by header, and the ledger."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.schemas import KPI_TABLES
from ledgerlens.session import new_path
from ledgerlens.sources import csv_folder, ledger
from ledgerlens.sources.files import Loaded

CTR = ",".join(KPI_TABLES["ctr_reporting_kpi"].names)


def load(spark, folder, target):
    return csv_folder.load_csv_folder(spark, str(folder), target, KPI_TABLES)


def test_many_files_in_as_many_reads_as_headers(spark, tmp_path, monkeypatch):
    for i in range(60):
        header = "x,y" if i % 2 else "y,z"
        (tmp_path / f"part {i}-of+60%.csv").write_text(header + "\n" + f"{i},é\n" * (i % 4))
    reads = []
    group = csv_folder._load_group
    monkeypatch.setattr(csv_folder, "_load_group", lambda *a: reads.append(a[5]) or group(*a))
    target = new_path(spark, "tables")
    got = load(spark, tmp_path, target)
    assert len(got) == 60 and len(reads) == 2
    assert all(x.error is None and x.rows == int(n.split()[1].split("-")[0]) % 4 for n, (_, x) in got.items())
    assert [tuple(r) for r in spark.read.parquet(f"{target}/{got['part 3-of+60%.csv'][0]}").collect()] == [("3", "é")] * 3
    assert spark.read.parquet(f"{target}/{got['part 4-of+60%.csv'][0]}").columns == ["y", "z"]


def test_a_file_that_breaks_is_set_apart(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"t{i}.csv").write_text("a,b\n1,2\n")
    broken = b"a,b\n" + b"1,2\n" * 3
    (tmp_path / "t3.csv").unlink()
    (tmp_path / "t3.csv").mkdir()
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header only.csv").write_text("a,b\n")
    (tmp_path / "fine.csv").write_bytes(broken)
    target = new_path(spark, "tables")
    got = load(spark, tmp_path, target)
    assert got["fine.csv"][1] == Loaded(rows=3) and got["header only.csv"][1] == Loaded(rows=0)
    assert spark.read.parquet(f"{target}/header_only").columns == ["a", "b"]
    assert "no header" in got["empty.csv"][1].error
    assert all(got[f"t{i}.csv"][1] == Loaded(rows=1) for i in range(7) if i != 3)


def test_halving_finds_the_file(spark, tmp_path, monkeypatch):
    for i in range(8):
        (tmp_path / f"t{i}.csv").write_text("a\n1\n")
    listed = csv_folder._escaped
    monkeypatch.setattr(csv_folder, "_escaped", lambda n: "gone.csv" if n == "t5.csv" else listed(n))
    got = load(spark, tmp_path, new_path(spark, "tables"))
    assert [n for n, (_, x) in got.items() if x.error] == ["t5.csv"]
    assert sum(x.rows for _, x in got.values()) == 7


def test_declared_tables_typed_by_name_with_bad_values(spark, tmp_path):
    (tmp_path / "ctr_reporting_kpi.csv").write_text("note," + CTR + "\nn,A,B,2025-01,1,x,3\nn,A,C,2025-01,,2,y\n")
    (tmp_path / "kyc_edd_kpi.csv").write_text("bank_name\nA\n")
    (tmp_path / "dup.csv").write_text("a,A,,b\n1,2,3,4\n")
    target = new_path(spark, "tables")
    got = load(spark, tmp_path, target)
    assert got["ctr_reporting_kpi.csv"][1] == Loaded(rows=2, bad_values=2)
    assert spark.read.parquet(f"{target}/ctr_reporting_kpi").schema == KPI_TABLES["ctr_reporting_kpi"]
    assert "branch" in got["kyc_edd_kpi.csv"][1].error
    assert spark.read.parquet(f"{target}/dup").columns == ["a0", "A1", "_c2", "b"]


def test_a_table_is_replaced_and_kept_when_its_file_breaks(spark, tmp_path):
    path, target = tmp_path / "t.csv", new_path(spark, "tables")
    path.write_text("a\n1\n2\n")
    load(spark, tmp_path, target)
    path.write_text("b\n5\n")
    load(spark, tmp_path, target)
    assert [r.b for r in spark.read.parquet(f"{target}/t").collect()] == ["5"]
    path.write_text("")
    assert load(spark, tmp_path, target)["t.csv"][1].error
    assert spark.read.parquet(f"{target}/t").count() == 1


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    assert load(spark, tmp_path, new_path(spark, "tables")) == {}


@pytest.fixture
def target(spark, tmp_path):
    (tmp_path / "ctr_reporting_kpi.csv").write_text(CTR + "\nA,B,2025-01,1,x,3\n")
    (tmp_path / "other.csv").write_text("a\n1\n2\n")
    (tmp_path / "empty.csv").write_text("")
    place = new_path(spark, "ingested")
    docs = spark.createDataFrame([(1, "f", "en", "a b c"), (2, "f", "en", "d"), (3, "g", "en", ""), (4, "h", "de", None)], "doc_id long, source_file string, file_type string, text string")
    assert ledger.ingest_chunks(docs, place, "run1", max_tokens=2) == (4, 3)
    ledger.ingest_tables(spark, str(tmp_path), place, "run1")
    return place


def test_a_row_per_file_and_run(spark, tmp_path, target):
    rows = {(r.run, r.file_name): (r.status, r.table_name, r.rows, r.bad_values, r.chunks) for r in ledger.read_ledger(spark, target).collect()}
    assert rows == {
        ("run1", "f"): ("loaded", "chunks", 0, 0, 3),
        ("run1", "g"): ("empty", None, 0, 0, 0),
        ("run1", "h"): ("empty", None, 0, 0, 0),
        ("run1", "ctr_reporting_kpi.csv"): ("loaded", "ctr_reporting_kpi", 1, 1, 0),
        ("run1", "other.csv"): ("loaded", "other", 2, 0, 0),
        ("run1", "empty.csv"): ("failed", None, 0, 0, 0),
    }
    # Another run is appended; one that is run again replaces its own rows.
    for _ in range(2):
        ledger.ingest_tables(spark, str(tmp_path), target, "run2")
    assert ledger.read_ledger(spark, target).where("run = 'run2'").count() == 3
    assert ledger.read_ledger(spark, target).count() == 9


def test_summary_of_runs(spark, target):
    got = {r.file_type: r for r in ledger.run_summary(ledger.read_ledger(spark, target)).collect()}
    csvs, english = got["CSV"], got["en"]
    assert (csvs.files_listed, csvs.files_loaded, csvs.files_failed, csvs.tables_created, csvs.rows, csvs.bad_values) == (3, 2, 1, 2, 3, 1)
    assert (english.files_listed, english.files_loaded, english.chunks_stored) == (2, 1, 3)
    assert ledger.read_ledger(spark, target).where(F.col("error").isNotNull()).count() == 1
