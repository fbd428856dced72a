"""Questions to contexts in one plan, for any number of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import routing
from ledgerlens.functions.text import clean_text, excerpt
from ledgerlens.operators import assembly
from ledgerlens.operators.keyword_search import first_hits_per_topic, keyword_batch
from ledgerlens.operators.vector_search import vector_topk
from ledgerlens.plans.metrics import metric_answers
from ledgerlens.session import materialise

NEIGHBOURS = 5
BROADCAST_BYTES = 64 << 20

def routed(questions: DataFrame) -> DataFrame:
    q = F.col("question")
    return questions.withColumns(
        {
            "needs_sql": routing.needs_sql(q),
            "needs_docs": routing.needs_docs(q),
            "route": routing.route(q),
        }
    )


def document_hits(
    questions: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame | Callable[[DataFrame], DataFrame],
    k: int = NEIGHBOURS,
) -> DataFrame:
    """Vector hits of the questions that use documents: all chunks of each winner, with metadata.

    Vectors belong to documents; ``chunks`` has a row per chunk of at most 500
    words, or is a function that gives those of certain documents, as where
    chunks are not stored and only winners are to be cut. ``place`` orders the
    chunks of a question, by rank and then by their order in the document.

    The ranking sees keys and vectors. The winners are written first: their
    size is then known, and while it is small they are broadcast and the texts
    stay where they are. Beyond that the texts are first cut down to those of
    winners by the winners' distinct keys, of which there are no more than
    rows in the corpus, so what is shuffled is what is needed.
    """
    wanting = questions.where(F.col("needs_docs") | ~F.col("needs_sql"))
    winners = materialise(vector_topk(wanting, vectors, k, query_key="conv_id"), "winners")
    keys = winners.select("doc_id").distinct()
    # A key and its place in a hash table take some 40 bytes, a winner some 80.
    few_keys = 40 * keys.count() <= BROADCAST_BYTES
    if callable(chunks):
        chunks = chunks(F.broadcast(keys) if few_keys else keys)
    elif few_keys and 80 * winners.count() > BROADCAST_BYTES:
        chunks = chunks.join(F.broadcast(keys), "doc_id", "left_semi")
    if 80 * winners.count() <= BROADCAST_BYTES:
        return _placed(chunks.join(F.broadcast(winners), "doc_id"))
    return _placed(winners.join(chunks, "doc_id"))


def _placed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("place", F.struct("rank", "chunk_ord"))


def keyword_hits(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Keyword hits among the chunks, as excerpts, of the document questions that pass the gate.

    Only the excerpts of the few hits are broadcast.
    """
    gated = questions.where(F.col("needs_docs") & routing.keyword_gate(F.col("question")))
    order = ["doc_id", "chunk_ord"]
    hits = first_hits_per_topic(chunks, order, "chunk_text")
    shown = hits.withColumn("excerpt", excerpt(clean_text(F.col("chunk_text")))).drop("chunk_text")
    return keyword_batch(gated, shown, order, "conv_id")


def answer_questions(
    questions: DataFrame, vectors: DataFrame, chunks: DataFrame, tables: dict[str, DataFrame]
) -> DataFrame:
    """(conv_id, route, context) for questions (conv_id, question, embedding).

    ``vectors`` has (doc_id, embedding), ``chunks`` the stored chunks with
    their metadata, read three times; ``tables`` the KPI tables by name.
    """
    asked = materialise(routed(questions), "questions")  # four branches read it
    metrics = metric_answers(asked.where("needs_sql"), tables, "conv_id").select("conv_id", "block")
    return assembly.assemble_context(
        asked.select("conv_id", "route", "needs_sql", "needs_docs"),
        "conv_id",
        metrics,
        assembly.citation_blocks(document_hits(asked, vectors, chunks), "conv_id", "chunk_text", "place"),
        assembly.keyword_blocks(keyword_hits(asked, chunks), "conv_id"),
    ).select("conv_id", "route", "context")
