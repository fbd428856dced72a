"""Rendering evidence as text: citation blocks, result blocks, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import clean_text, shown
from ledgerlens.operators.ranking import row_cap

# The layout of a context.
BLOCK_SEPARATOR = "\n\n---\n\n"
SECTION_RULE = "=" * 70
NO_SOURCE = "I don't have that information in my Knowledge Base."
UNKNOWN = "Unknown"
EXECUTED = "SQL Query Executed:\n"
RESULTS = "\n\nResults:\n"
FIRST_ROWS = "\n(Showing first {} of %d rows)"
TOTAL_ROWS = "\n\nTotal rows: "
NO_ROWS = "No results found for this query."
DOCUMENTS_HEADING = "Document Context"
METRICS_HEADING = "SQL Query Results"
KEYWORDS_HEADING = "\n[Additional Keyword Matches]\n"


def _in_rank_order(rank: str, text: Column, separator: str) -> Column:
    """Join texts in rank order. Groups are top-k lists, so their size is bounded."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), text.alias("text"))))
    return F.array_join(F.transform(blocks, lambda b: b.getField("text")), separator)


def citation(text: Column) -> Column:
    """'[type: file]' above the text; missing metadata reads Unknown."""
    kind = F.coalesce("file_type", F.lit(UNKNOWN))
    source = F.coalesce("source_file", F.lit(UNKNOWN))
    return F.concat(F.lit("["), kind, F.lit(": "), source, F.lit("]\n"), text)


def citation_blocks(
    hits: DataFrame, query_key: str, text: str = "text", rank: str = "rank", clean: bool = True
) -> DataFrame:
    """(query_key, doc_context): the cited texts of each question in rank order."""
    body = clean_text(F.col(text)) if clean else F.col(text)
    return hits.groupBy(query_key).agg(
        _in_rank_order(rank, citation(body), BLOCK_SEPARATOR).alias("doc_context")
    )


def keyword_blocks(
    hits: DataFrame, query_key: str, text: str = "excerpt", rank: str = "rank"
) -> DataFrame:
    """(query_key, keyword_context): the cited excerpts of the keyword hits in rank order."""
    return hits.groupBy(query_key).agg(
        _in_rank_order(rank, citation(F.col(text)), BLOCK_SEPARATOR).alias("keyword_context")
    )


def _cell(column: str, kind: str) -> Column:
    """Fractions in fixed notation, as engines print doubles differently."""
    value = F.col(column)
    return shown(value.cast("decimal(18,2)") if kind == "double" else value)


def result_block(
    df: DataFrame, order: list[Column], statement: str, limit: int = 100, shown_rows: int = 50
) -> DataFrame:
    """One row, ``block``: a result set of a statement as text."""
    columns = df.columns
    header = " | ".join(columns)
    rule = "-+-".join("-" * max(len(c), 3) for c in columns)
    capped = row_cap(df, order, limit, shown_rows)
    line = F.concat_ws(" | ", *[_cell(c, kind) for c, kind in df.dtypes])
    total = F.coalesce(F.max("total_rows"), F.lit(0))
    lines = _in_rank_order("row_no", line, "\n")
    note = F.when(
        total > shown_rows,
        F.format_string(FIRST_ROWS.format(shown_rows), total),
    ).otherwise("")
    found = F.concat(
        F.lit(f"{EXECUTED}{statement}{RESULTS}{header}\n{rule}\n"),
        lines,
        note,
        F.lit(TOTAL_ROWS),
        total.cast("string"),
    )
    nothing = F.lit(f"{EXECUTED}{statement}\n\n{NO_ROWS}")
    return capped.agg(F.when(total > 0, found).otherwise(nothing).alias("block"))


def _section(heading: str, body: Column) -> Column:
    """A headed section, or NULL without a body; concat_ws then skips it."""
    return F.concat(F.lit(f"[{heading}]\n"), body)


def assemble_context(
    questions: DataFrame,
    query_key: str,
    sql_blocks: DataFrame,
    doc_blocks: DataFrame,
    keyword: DataFrame,
) -> DataFrame:
    """Add ``context`` to routed questions.

    ``questions`` has ``needs_sql`` and ``needs_docs``; the other inputs have
    one row per question at most: ``block``, ``doc_context`` and
    ``keyword_context``. Without any section the documents alone are used.
    The rule stands once, before the first section.
    """
    parts = (
        questions.join(sql_blocks, query_key, "left")
        .join(doc_blocks, query_key, "left")
        .join(keyword, query_key, "left")
    )
    extra = F.concat(F.lit(KEYWORDS_HEADING), F.col("keyword_context"))
    both = F.nullif(F.concat_ws("\n", "doc_context", extra), F.lit(""))
    documents = F.when(F.col("needs_docs"), _section(DOCUMENTS_HEADING, both)).when(
        ~F.col("needs_sql"), _section(DOCUMENTS_HEADING, F.col("doc_context"))
    )
    metrics = F.when(F.col("needs_sql"), _section(METRICS_HEADING, F.col("block")))
    return parts.select(
        *questions.columns,
        F.concat(F.lit("\n\n" + SECTION_RULE), F.concat_ws("\n\n", metrics, documents)).alias(
            "context"
        ),
    )


def cited_sources(questions: DataFrame, hits: DataFrame, query_key: str) -> DataFrame:
    """The distinct source files behind each question's hits, or the fallback phrase."""
    files = hits.groupBy(query_key).agg(
        F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("_files")
    )
    return questions.join(files, query_key, "left").select(
        *questions.columns, F.coalesce("_files", F.lit(NO_SOURCE)).alias("sources")
    )
