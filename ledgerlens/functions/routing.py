"""Which evidence a question asks for. All tests are substring tests on the lower-cased question."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# The trigger terms of the router.
ANALYTICAL_TERMS = (
    "count",
    "total",
    "average",
    "rate",
    "most",
    "least",
    "highest",
    "lowest",
    "which branch",
    "how many",
    "compare",
)
DOCUMENT_TERMS = (
    "regulation",
    "policy",
    "guideline",
    "requirement",
    "what does",
    "explain",
    "how to",
    "what are",
    "compliance",
    "rule",
    "law",
    "standard",
    "aml",
    "cft",
)
KEYWORD_GATE_TERMS = ("ctr", "str", "cash transaction", "suspicious transaction")


def mentions_any(question: Column, terms: tuple[str, ...]) -> Column:
    """True when any term occurs; a missing question mentions nothing."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return functools.reduce(operator.or_, [F.contains(low, F.lit(t)) for t in terms])


def needs_sql(question: Column) -> Column:
    return mentions_any(question, ANALYTICAL_TERMS)


def needs_docs(question: Column) -> Column:
    return mentions_any(question, DOCUMENT_TERMS)


def keyword_gate(question: Column) -> Column:
    return mentions_any(question, KEYWORD_GATE_TERMS)


def route(question: Column) -> Column:
    """'both', 'sql', 'docs', or 'default' (documents, without the keyword search)."""
    sql, docs = needs_sql(question), needs_docs(question)
    return (
        F.when(sql & docs, "both").when(sql, "sql").when(docs, "docs").otherwise("default")
    )


def last_message(messages: Column) -> Column:
    """Content of the last {role, content} element, whatever its role."""
    return F.try_element_at(messages, F.lit(-1)).getField("content")
