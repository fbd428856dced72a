"""Keyword search by topic rules, for one question or very many."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.routing import mentions_any
from ledgerlens.operators.kpi import any_topic, folded, topic_matches
from ledgerlens.operators.ranking import top_per_group

HITS = 3


@dataclass(frozen=True)
class TopicRule:
    """A question mentioning a trigger asks for texts matching the patterns.

    ``last_resort`` rules apply only to questions no other rule applies to.
    """

    topic: str
    triggers: tuple[str, ...]
    required: str
    any_of: tuple[str, ...] = ()
    last_resort: bool = False


# The topics of the keyword search.
TOPIC_RULES = (
    TopicRule(
        "ctr",
        ("ctr", "cash transaction"),
        "%cash transaction report%",
        ("%branch%prepare%", "%submit%bfiu%", "%monthly%ctr%", "%report%ccu%"),
    ),
    TopicRule(
        "str",
        ("str", "suspicious transaction"),
        "%suspicious transaction%",
        ("%report%bfiu%", "%submit%sar%"),
    ),
    TopicRule("kyc", ("kyc",), "%know your customer%"),
    TopicRule("aml", ("aml",), "%anti money laundering%", last_resort=True),
)


def _asked(question: Column, rules: tuple[TopicRule, ...]) -> list[Column]:
    """Per rule, whether the question asks for its topic."""
    mentioned = [mentions_any(question, r.triggers) for r in rules]
    first = functools.reduce(
        operator.or_, [m for r, m in zip(rules, mentioned) if not r.last_resort]
    )
    return [m & ~first if r.last_resort else m for r, m in zip(rules, mentioned)]


def question_topics(question: Column, rules: tuple[TopicRule, ...] = TOPIC_RULES) -> Column:
    """The topics a question asks for, comma-separated; empty if none."""
    return F.concat_ws(
        ",", *[F.when(asked, F.lit(r.topic)) for r, asked in zip(rules, _asked(question, rules))]
    )


def text_topics(low: Column, rules: tuple[TopicRule, ...] = TOPIC_RULES) -> Column:
    """Array of the topics a lower-cased text matches."""
    return F.array_compact(
        F.array(
            *[F.when(topic_matches(low, r.required, r.any_of), F.lit(r.topic)) for r in rules]
        )
    )


def first_hits_per_topic(
    chunks: DataFrame,
    order: list[str],
    text: str = "chunk_text",
    rules: tuple[TopicRule, ...] = TOPIC_RULES,
    limit: int = HITS,
) -> DataFrame:
    """The first matching chunks of every topic: at most ``limit`` rows per rule.

    The ranking sees keys and topics only; the few winners then fetch their
    texts by a broadcast of as many keys as there are rules times ``limit``.
    """
    # The folded text is a column of its own so that all rules share it.
    keys = (
        chunks.withColumn("_low", F.lower(text))
        .select(*order, text_topics(F.col("_low"), rules).alias("_topics"))
        .select(*order, F.explode("_topics").alias("topic"))
    )
    first = top_per_group(keys, "topic", [F.asc(c) for c in order], limit).drop("rank")
    return chunks.join(F.broadcast(first), order)


def keyword_search(
    chunks: DataFrame,
    question: str,
    order: list[str],
    text: str = "chunk_text",
    rules: tuple[TopicRule, ...] = TOPIC_RULES,
    limit: int = HITS,
) -> DataFrame:
    """The first chunks, in ``order``, that match any topic of one question.

    Whether the question asks for a topic is folded at planning, so the scan
    tests the patterns of its own topics only.
    """
    wanted = _asked(F.lit(question), rules)
    matches = folded(
        F.col(text),
        lambda low: any_topic(
            [w & topic_matches(low, r.required, r.any_of) for r, w in zip(rules, wanted)]
        ),
    )
    return chunks.where(matches).orderBy(*order).limit(limit)


def keyword_batch(
    questions: DataFrame,
    hits: DataFrame,
    order: list[str],
    query_key: str,
    question: str = "question",
    rules: tuple[TopicRule, ...] = TOPIC_RULES,
    limit: int = HITS,
) -> DataFrame:
    """:func:`keyword_search` for every question, from :func:`first_hits_per_topic`.

    A question's answer depends only on the set of topics it asks for, and
    the first hits of a set are among the first hits of its topics. So one
    scan of the chunks finds the hits of each topic; they are combined for the
    topic sets that occur (at most two to the number of rules) and handed to
    the questions by a join that shuffles neither questions nor chunks. Both
    broadcast tables have a few rows per rule, however large the inputs are;
    cut ``hits`` to the columns wanted when texts are long.
    """
    asked = questions.select(
        query_key, question_topics(F.col(question), rules).alias("_topics")
    ).where(F.col("_topics") != "")
    per_set = (
        asked.select("_topics")
        .distinct()
        .withColumn("topic", F.explode(F.split("_topics", ",")))
        .join(F.broadcast(hits), "topic")
        .drop("topic")
        .dropDuplicates(["_topics", *order])
    )
    per_set = top_per_group(per_set, "_topics", [F.asc(c) for c in order], limit)
    return asked.join(F.broadcast(per_set), "_topics").drop("_topics")
