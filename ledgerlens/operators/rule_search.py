"""Keyword search by rules that are a table: thousands of them, without a longer plan.

A LIKE pattern can match only a text that holds all its literal pieces, so each pattern is indexed
by one trigram of its longest piece, the one that is rarest in a sample of the texts. A few hundred
trigrams are looked for in each text one by one; where there are more, a text's trigrams are met with
those in an equi-join. LIKE is tried on the pairs that meet.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.keyword_search import HITS, TOPIC_RULES, TopicRule
from ledgerlens.operators.ranking import top_per_group
from ledgerlens.session import materialise

BROADCAST_BYTES = 64 << 20
FEW = 256  # grams that are looked for one by one: a pass over the text each, cheaper than all the text's trigrams
SAMPLE = 16  # one text in so many tells which trigrams are rare; that decides speed, not results


@dataclass(frozen=True)
class Rules:
    """``triggers`` (topic, trigger, last_resort): a question that mentions a trigger asks for the topic; those of
    last resort only if it asks for no other. ``patterns`` (topic, clause, pattern): a text is about a topic if each
    of the topic's clauses has a pattern that it matches."""

    triggers: DataFrame
    patterns: DataFrame


def rule_tables(spark: SparkSession, rules: Iterable[TopicRule] = TOPIC_RULES) -> Rules:
    """Rules as tables."""
    rules = list(rules)
    triggers = [(r.topic, t, r.last_resort) for r in rules for t in r.triggers]
    patterns = [(r.topic, 0, r.required) for r in rules] + [(r.topic, 1, p) for r in rules for p in r.any_of]
    return Rules(
        spark.createDataFrame(triggers, "topic string, trigger string, last_resort boolean"),
        spark.createDataFrame(patterns, "topic string, clause int, pattern string"),
    )


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` characters of a text, overlapping, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _own_grams(pattern: Column) -> Column:
    """What the longest literal piece of a pattern is indexed by: trigrams, or all of a shorter piece."""
    pieces = F.split(pattern, r"\\.|[%_\\]")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))
    return F.when(longest["n"] >= 3, _grams(longest["p"], 3)).otherwise(F.array(longest["p"]))


def like_matches(texts: DataFrame, key: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern): which of the distinct ``patterns`` the lower-cased texts match, as LIKE has it.

    Patterns without a literal piece are tried on every text. Patterns are
    measured: while they are small the texts are read in place and only pairs
    that meet leave the scan, those of at most ``FEW`` grams by plain tests for
    these instead of the trigrams of every text; beyond that keys and trigrams are shuffled, and
    texts are fetched for the pairs that meet. A missing text matches nothing.
    """
    low = texts.select(*key, F.lower(text).alias("_low")).where("_low IS NOT NULL")
    own = materialise(patterns.select("pattern").where("pattern IS NOT NULL").distinct().select("pattern", _own_grams(F.col("pattern")).alias("_grams")), "patterns")
    listed = own.select(F.explode("_grams").alias("_gram")).distinct()
    # At most four: patterns of no literal, of pieces of one or two characters, and all others.
    lengths = sorted(r[0] for r in listed.select(F.char_length("_gram")).distinct().collect())
    if not lengths:
        return low.where("false").select(*key, F.lit("").alias("pattern"))
    every = [_grams(F.col("_low"), n) if n else F.array(F.lit("")) for n in lengths]
    grams = F.flatten(F.array(*every))
    n_bytes, n_listed = listed.agg(F.coalesce(F.sum(F.octet_length("_gram") + 48), F.lit(0)), F.count(F.lit(1))).first()
    small = n_bytes <= BROADCAST_BYTES

    def held(texts: DataFrame, some: DataFrame, n: int) -> DataFrame:
        """(key, _low, _gram): which of ``some`` grams the texts hold."""
        these = texts.withColumn("_these", some.agg(F.collect_set("_gram")).scalar())
        found = F.filter("_these", lambda g: F.contains(F.col("_low"), g)) if n <= FEW else F.array_intersect(grams, F.col("_these"))
        return these.select(*key, "_low", F.explode(found).alias("_gram"))

    sample = low.where(F.pmod(F.xxhash64(*key), F.lit(SAMPLE)) == 0)
    sample = held(sample, listed, n_listed) if small else sample.select(F.explode(grams).alias("_gram"))
    rare = sample.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    ranked = own.select("pattern", F.explode("_grams").alias("_gram")).join(rare, "_gram", "left")
    least = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_least")
    anchors = materialise(ranked.groupBy("pattern").agg(least).select("pattern", F.col("_least._gram").alias("_gram")), "anchors")
    fits = F.like(F.col("_low"), F.col("pattern"))
    if small:
        n_anchors = anchors.select("_gram").distinct().count()
        met = held(low, anchors, n_anchors).join(F.broadcast(anchors), "_gram")
        return met.where(fits).select(*key, "pattern")
    met = low.select(*key, F.explode(grams).alias("_gram")).join(anchors, "_gram").select(*key, "pattern")
    return met.join(low, key).where(fits).select(*key, "pattern")


def text_topics(texts: DataFrame, key: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """(key, topic): the topics that each text is about."""
    found = like_matches(texts, key, text, patterns).join(patterns.distinct(), "pattern")
    clauses = patterns.groupBy("topic").agg(F.count_distinct("clause").alias("_clauses"))
    held = found.groupBy(*key, "topic").agg(F.count_distinct("clause").alias("_held"))
    return held.join(clauses, "topic").where(F.col("_held") == F.col("_clauses")).select(*key, "topic")


def question_topics(questions: DataFrame, key: str, question: str, triggers: DataFrame) -> DataFrame:
    """(key, topic): the topics that each question asks for."""
    literal = F.regexp_replace("trigger", r"([%_\\])", r"\\$1")
    listed = triggers.select("topic", "last_resort", F.concat(F.lit("%"), literal, F.lit("%")).alias("pattern")).distinct()
    found = like_matches(questions, [key], question, listed).join(listed, "pattern")
    topics = found.groupBy(key, "topic").agg(F.bool_and("last_resort").alias("_last"))
    others = topics.groupBy(key).agg(F.bool_and("_last").alias("_only_last"))
    return topics.join(others, key).where(~F.col("_last") | F.col("_only_last")).select(key, "topic")


def rule_batch(
    questions: DataFrame,
    chunks: DataFrame,
    rules: Rules,
    order: list[str],
    query_key: str,
    question: str = "question",
    text: str = "chunk_text",
    limit: int = HITS,
) -> DataFrame:
    """(query_key, chunk columns, rank): for every question the first chunks, in ``order``, about a topic it asks for.

    A question's first hits are among the first of its topics, so the chunks
    are ranked once per topic, and only those few are met with the questions
    and fetch their texts.
    """
    first = top_per_group(text_topics(chunks, order, text, rules.patterns), "topic", [F.asc(c) for c in order], limit).drop("rank")
    first = materialise(first, "first-hits")
    asked = question_topics(questions, query_key, question, rules.triggers)
    hits = asked.join(first, "topic").select(query_key, *order).distinct()
    best = materialise(top_per_group(hits, query_key, [F.asc(c) for c in order], limit), "hits")
    keys = first.select(*order).distinct()
    small = 64 * keys.count() <= BROADCAST_BYTES
    texts = chunks.join(F.broadcast(keys) if small else keys, order, "left_semi")
    return best.join(texts, order)
