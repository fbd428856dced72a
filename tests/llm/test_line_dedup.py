"""Line dedup against a plain Python version."""

from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlens.llm.line_dedup import frequent_line_dedup

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def slow(rows, min_docs, min_chars=1):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    drop = {k for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in drop]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_matches_plain_version(spark):
    rows = [(i, f"Own {i}\n  SHARED line\t\n\n{'tail' if i % 2 else ' Tail '}\nend {i % 5}") for i in range(20)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "shared LINE"), (24, "É\né\nÉ"), (24, "É\né\nÉ"), (None, "own 0"),
             (25, "x\n" * 3000 + "shared line"), (25, "another text of this id"), (26, " \x0b\x0c\r\n a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit(c) for c in ("_key", "_h1", "_lines", "_row", "line")}
    )
    for bound in (2, 4, 10):
        found = sorted(map(tuple, frequent_line_dedup(docs, bound).collect()), key=str)
        assert found == slow(rows, bound)
    assert sorted(map(tuple, frequent_line_dedup(docs, 2, 5).collect()), key=str) == slow(rows, 2, 5)


def test_empty_and_carried(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id bigint, text string, lang string")
    assert frequent_line_dedup(docs.limit(0)).count() == 0
    assert frequent_line_dedup(docs, carry=("lang",)).columns == ["doc_id", "lang", "text", "n_lines", "n_dropped"]


def test_whole_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = sorted(map(tuple, frequent_line_dedup(docs, 3).collect()), key=str)
    assert found == slow(rows, 3)
    assert any(r[3] for r in found)
