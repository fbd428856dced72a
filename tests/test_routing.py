import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import routing
from ledgerlens.operators.keyword_search import (
    TOPIC_RULES,
    first_hits_per_topic,
    keyword_batch,
    keyword_search,
    question_topics,
)

# (question, needs_sql, needs_docs, gate, topics)
QUESTIONS = [
    ("How large was one branch's STR breach count in March?", True, False, True, ["str"]),
    ("CTR filing: what are the rules?", False, True, True, ["ctr"]),
    ("Name the branches with the least trained staff", True, False, False, []),
    ("The highest number of unreported CTRs, and where", True, False, True, ["ctr"]),
    ("List the CTR figures of one branch for spring", False, False, True, ["ctr"]),
    ("Requirements for a Cash Transaction Report", False, True, True, ["ctr"]),
    ("Duties of the AML/CFT unit", False, True, False, ["aml"]),
    ("Guideline on KYC for risky customers", False, True, False, ["kyc"]),
    ("Total KYC backlog, and explain the policy", True, True, False, ["kyc"]),
    ("AML rule on suspicious transactions and KYC", False, True, True, ["str", "kyc"]),
    # Substrings count, inside longer words too.
    ("Corporate strategy", True, False, True, ["str"]),
    ("An account in another country", True, False, False, []),
    ("A flaw, almost", True, True, False, []),
    ("Restriction", False, False, True, ["str"]),
    ("", False, False, False, []),
    (None, False, False, False, []),
]


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, q[0]) for i, q in enumerate(QUESTIONS)]
    return spark.createDataFrame(rows, "qid long, question string")


def test_flags_routes_and_topics(asked):
    q = F.col("question")
    out = asked.select(
        "qid",
        routing.needs_sql(q),
        routing.needs_docs(q),
        routing.keyword_gate(q),
        question_topics(q),
        routing.route(q),
    )
    for qid, sql, docs, gate, topics, route in out.collect():
        assert (sql, docs, gate, topics) == (*QUESTIONS[qid][1:4], ",".join(QUESTIONS[qid][4]))
        expected = {(1, 1): "both", (1, 0): "sql", (0, 1): "docs", (0, 0): "default"}
        assert route == expected[(sql, docs)]


def test_last_message(spark):
    df = spark.createDataFrame(
        [([("user", "a"), ("assistant", "b")],), ([],)],
        "messages array<struct<role:string,content:string>>",
    )
    got = [r[0] for r in df.select(routing.last_message(F.col("messages"))).collect()]
    assert got == ["b", None]


CHUNKS = [
    (1, "the Branch shall PREPARE a cash transaction report"),  # pattern order is wrong
    (2, "cash transaction report: every branch must prepare it"),
    (3, "Suspicious Transaction: submit the SAR"),
    (4, "know your customer"),
    (5, "anti money laundering"),
    (6, "cash transaction report"),
    (7, "monthly CTR as a cash transaction report"),
    (8, "report the suspicious transaction to bfiu"),
    (9, "know your customer again"),
]


def like(low, pattern):
    at = 0
    for part in pattern.strip("%").split("%"):
        at = low.find(part, at)
        if at < 0:
            return False
        at += len(part)
    return True


def brute_hits(question):
    low_q = (question or "").lower()
    rules = [r for r in TOPIC_RULES if not r.last_resort and any(t in low_q for t in r.triggers)]
    rules = rules or [r for r in TOPIC_RULES if r.last_resort and any(t in low_q for t in r.triggers)]
    hits = []
    for i, t in CHUNKS:
        low = t.lower()
        if any(
            like(low, r.required) and (not r.any_of or any(like(low, p) for p in r.any_of))
            for r in rules
        ):
            hits.append(i)
    return hits[:3]


def test_keyword_search_and_batch_agree_with_brute_force(spark, asked):
    chunks = spark.createDataFrame(CHUNKS, "id long, chunk_text string")
    batch = {}
    for r in keyword_batch(asked, first_hits_per_topic(chunks, ["id"]), ["id"], "qid").collect():
        batch.setdefault(r.qid, []).append((r["rank"], r.id))
    for qid, (question, *_rest) in enumerate(QUESTIONS):
        expected = brute_hits(question)
        assert [i for _, i in sorted(batch.get(qid, []))] == expected
        if question:
            single = keyword_search(chunks, question, ["id"]).select("id").collect()
            assert [r.id for r in single] == expected


def test_like_without_backtracking_equals_like(spark):
    from ledgerlens.operators.kpi import holds_in_order

    texts = ["ab", "ba", "aab b", "xaxbx", "aa", "", "b a b", "a%b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("%a%b%", "%ab%", "a%b", "%a%a%", "%a_b%", "%", "%%"):
        t = F.col("t")
        assert df.where(holds_in_order(t, pattern) != t.like(pattern)).count() == 0
