import os
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlens.plans import ingest
from ledgerlens.schemas import KPI_TABLES
from ledgerlens.session import drop_scratch, materialise, new_path
from ledgerlens.sources import chunk_store, files
from ledgerlens.sources.files import load_csv


def test_discover_files(spark, tmp_path):
    for name in ("a.pdf", "b.csv", "c.CSV", "d.txt", "e.pdf.bak"):
        (tmp_path / name).write_text("xyz")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f.pdf").write_text("x")
    found = files.discover_files(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("a.pdf", 3, "PDF"), ("b.csv", 3, "CSV")]
    with pytest.raises(AnalysisException):
        files.discover_files(spark, str(tmp_path / "absent"))


def test_csv_months_stay_text(spark, tmp_path):
    path = tmp_path / "str_filing_kpi.csv"
    path.write_text(
        "bank_name,branch,month,str_filed_count,avg_str_filing_days,str_sla_breaches\n"
        "B,X,2025-03,4,,1\nB,Y,2025-04,5,2.5,0\n"
    )
    target = new_path(spark, "kpi")
    assert ingest.ingest_kpi_csv(spark, str(path), "str_filing_kpi", target).rows == 2
    assert ingest.ingest_kpi_csv(spark, str(path), "str_filing_kpi", target).rows == 2  # replaced
    loaded = spark.read.parquet(target)
    assert loaded.schema == KPI_TABLES["str_filing_kpi"]
    assert [r.month for r in loaded.orderBy("branch").collect()] == ["2025-03", "2025-04"]
    assert ingest.ingest_kpi_csv(spark, str(tmp_path / "none.csv"), "str_filing_kpi", target).error


def test_reloading_gives_the_same_ids(spark):
    docs = spark.createDataFrame(
        [(1, "a.pdf", "PDF", "w " * 7), (2, "b.pdf", "PDF", "")],
        "doc_id long, source_file string, file_type string, text string",
    )
    target = new_path(spark, "chunks")
    first = ingest.ingest_documents(spark, docs, target, max_tokens=3).collect()
    again = ingest.ingest_documents(spark, docs, target, max_tokens=3).collect()
    assert sorted(first) == sorted(again) and len({r.id for r in first}) == 3
    chunk_store.reset_table(spark, target)
    assert chunk_store.scan_chunks(spark, target).count() == 0
    summary = chunk_store.ingest_summary(
        docs, docs.where("doc_id = 1").withColumn("n", F.lit(1)), "doc_id"
    ).first()
    assert summary[:] == ("PDF", 2, 1, 1)


def session_like(setting, master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, _: setting), sparkContext=context)


def test_scratch_folder_comes_from_the_session():
    cluster = session_like("/shared/place/", "yarn")
    assert new_path(cluster, "x").startswith("/shared/place/x-")
    assert new_path(cluster, "x") != new_path(cluster, "x")
    with pytest.raises(ValueError):
        new_path(session_like(None, "yarn"), "x")


def test_csv_folder(spark, tmp_path):
    (tmp_path / "kyc-edd kpi.csv").write_text(
        "bank_name,branch,month,edd_completed,edd_pending,high_risk_customers\nB,X,2025-03,1,2,3\n"
    )
    (tmp_path / "other.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "note.txt").write_text("a\n")
    target = new_path(spark, "tables")
    loaded = ingest.ingest_csv_folder(spark, str(tmp_path), target)
    assert loaded["kyc-edd kpi.csv"].rows == 1 and loaded["other.csv"].rows == 2 and "note.txt" not in loaded
    assert spark.read.parquet(f"{target}/kyc_edd_kpi").schema == KPI_TABLES["kyc_edd_kpi"]


CTR = KPI_TABLES["ctr_reporting_kpi"]


def test_csv_columns_go_by_name(spark, tmp_path):
    path, target = tmp_path / "ctr.csv", new_path(spark, "ctr")
    path.write_text("ctrs_unreported,branch,note,bank_name,ctrs_filed,month,txns_above_threshold\n1,Br,x,Ba,2,2025-03,n/a\n,B2,y,Ba,7,2025-04,3\n")
    loaded = load_csv(spark, str(path), CTR, target)
    assert (loaded.rows, loaded.bad_values, loaded.error) == (2, 1, None)
    rows = [tuple(r) for r in spark.read.parquet(target).orderBy("branch").collect()]
    assert rows == [("Ba", "B2", "2025-04", 7, None, 3), ("Ba", "Br", "2025-03", 2, 1, None)]


def test_missing_column_and_broken_file_leave_the_old_table(spark, tmp_path):
    path, target = tmp_path / "ctr.csv", new_path(spark, "ctr")
    path.write_text(",".join(CTR.names) + "\nA,B,2025-01,1,2,3\n")
    assert load_csv(spark, str(path), CTR, target).rows == 1
    path.write_text("bank_name,branch\nA,B\n")
    assert "month" in load_csv(spark, str(path), CTR, target).error
    # Named as if packed, but it is not: found out only while it is read.
    broken = tmp_path / "broken.csv.gz"
    broken.write_bytes(b"\x1f\x8b\x08 not packed")
    assert load_csv(spark, str(broken), None, target).error
    assert load_csv(spark, str(tmp_path / "absent.csv"), CTR, target).error
    assert spark.read.parquet(target).count() == 1


def test_a_broken_file_does_not_stop_a_folder_and_clashing_names_are_told(spark, tmp_path):
    (tmp_path / "a-b.csv").write_text("x\n1\n2\n")
    (tmp_path / "a b.csv").write_text("x\n1\n")
    (tmp_path / "ctr_reporting_kpi.csv").write_text("bank_name\nA\n")
    target = new_path(spark, "tables")
    loaded = ingest.ingest_csv_folder(spark, str(tmp_path), target)
    assert loaded["a b.csv"].rows == 1 and "a b.csv" in loaded["a-b.csv"].error
    assert loaded["ctr_reporting_kpi.csv"].error
    assert spark.read.parquet(f"{target}/a_b").count() == 1


def test_scratch_is_dropped(spark):
    df = materialise(spark.range(3), "kept")
    assert df.count() == 3
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    assert drop_scratch(spark) >= 1 and not os.path.exists(path)
    assert drop_scratch(spark) == 0


def test_ids_tell_neighbouring_keys_apart(spark):
    rows = spark.createDataFrame([("a", 1, 11), ("a", 11, 1), ("a1", 1, 1), (None, 1, 1), ("a", 1, 11)], "s string, d long, chunk_ord long")
    ids = [r.id for r in chunk_store.with_chunk_id(rows, "s", "d").collect()]
    assert len(set(ids)) == 4 and ids[0] == ids[4] and all(len(i) == 32 for i in ids)
