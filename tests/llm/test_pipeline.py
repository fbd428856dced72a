"""The pipeline over whole documents: every stage against its operator's plain version, and planted cases."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_line_dedup, test_simhash, test_suffix_dedup
from tests.llm import test_packing as packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data):
    """{stage: (rows before, rows after)}"""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), f"test-{name}")
        assert name == "packing" or sorted(docs.columns) == sorted(COLUMNS)
        after = docs.collect()
        out[name] = before, after
        before = [(r["doc_id"], r["text"]) for r in after] if name != "packing" else None
        assert name == "packing" or all(r["n_chars"] == len(r["text"]) for r in after)
    return out


def test_quality_rejects_bad_and_keeps_good(spark, data, stages):
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in after}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    texts = dict(before)
    long = [r for r in labels if len(texts[r["doc_id"]].split()) >= 100]
    good, bad = ([r["doc_id"] in kept for r in long if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.93 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_lines(stages):
    before, after = stages["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in after} == {r[0]: r[1] for r in test_line_dedup.slow(before, 10)}


def test_near_copies_leave_one(stages):
    before, after = stages["near_dedup"]
    roots = test_simhash.slow_components({i: test_simhash.slow_fingerprint(t) for i, t in before}, 4)
    assert sorted(r["doc_id"] for r in after) == sorted(set(roots.values())) and len(after) < len(before)


def test_repeats(stages):
    before, after = stages["suffix_dedup"]
    kept = {i: p[3].decode(errors="ignore") for (i, _), p in zip(before, test_suffix_dedup.plain([t for _, t in before]))}
    assert {r["doc_id"]: r["text"] for r in after} == kept


def test_packing(spark, data, stages):
    texts = [(r["doc_id"], r["text"]) for r in stages["suffix_dedup"][1]]
    packing.check(stages["packing"][1], texts)
    again = corpus_pipeline.run(spark, data).collect()
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in again) == Counter(
        (r["doc_id"], r["start"], r["length"]) for r in stages["packing"][1])


def test_planted_cases(spark, data, tmp_path):
    """Exact and near copies, a passage in three documents, a line in twelve; missing, empty and repeated rows."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    own = [prose(120) for _ in range(20)]
    passage, line = prose(60), "Shared  line of all"
    rows = [(i, t + "\n" + (f" {line}\t" if i < 12 else "end")) for i, t in enumerate(own)]
    rows += [(100 + i, own[i] + " " + passage + " " + prose(50)) for i in range(12, 15)]
    rows += [(200, rows[3][1]), (201, own[4] + "\n" + line.upper()), (202, None), (203, ""), (204, "#$% " * 100), (3, rows[3][1])]
    # Ids beyond those of the documents, which are there too: labels must not meet planted rows.
    at = 10**6
    docs = spark.createDataFrame([(at + i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(spark.read.parquet(f"{data}/documents.parquet").select(COLUMNS))
    seen = defaultdict(dict)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), "planted")
        seen[name] = {r["doc_id"] - at: r["text"] for r in docs.where(f"doc_id >= {at}").collect()}
    assert set(range(20)) <= set(seen["quality"]) and not {202, 203, 204} & set(seen["quality"])
    assert not any(line.lower() in t.lower() for t in seen["line_dedup"].values())
    assert {200, 201}.isdisjoint(seen["near_dedup"]) and {3, 4} <= set(seen["near_dedup"])
    assert docs.where(f"doc_id = {at + 3}").count() == 1
    assert not any(passage in t for t in seen["suffix_dedup"].values())
    assert seen["suffix_dedup"][0].strip() == own[0]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_genuine_replacement_characters_stay(spark, data):
    """A cut inside a character takes its bytes only; U+FFFD elsewhere in that text stays."""
    passage = "".join(f"{i:04d}-{i * i:06d}." for i in range(30))
    # \u00e9 and \u00e8 begin with the same byte, so the repeat ends inside them.
    rows = [(1, "first \ufffd own " + passage + "\u00e9 end \ufffd"), (2, "other " + passage + "\u00e8 rest")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeat_stage(spark, docs, data).collect()}
    want = {1: "first \ufffd own  end \ufffd".replace("own  end", "own end"), 2: "other rest"}
    assert got == {i: (t, len(t)) for i, t in want.items()}
