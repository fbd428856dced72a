"""Dropping lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WHITE_SPACE, Scratch, fold, two_hashes


def _lines(text: Column) -> Column:
    """The lines between line feeds; a missing or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_line_dedup(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    carry: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, ``carry`` columns, text, n_lines, n_dropped): documents without their frequent lines.

    The key of a line is the line without white space at both ends, A-Z in
    lower case. Keys of at least ``min_chars`` code points that ``min_docs``
    documents or more contain lose all their lines; the other lines stay as
    they are, joined by line feeds.

    Lines are exploded to (document, position, 128-bit hash), written once.
    Documents per hash are counted after a distinct, so one line held by a
    third of all documents meets as partial counts. The verdicts come back by
    a join that adaptive execution may split on a hot hash, are put in order
    of position per document, and only the last join carries texts.

    A missing text is one empty line and stays missing no more: it becomes
    ``''``. Repeated rows are each returned; a document is its id, so they
    count once, and rows without an id count as one document together. An
    empty table gives an empty table. Other columns are ignored unless
    carried.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    # Rows are told apart by id and text: rows equal in both have equal results.
    row = F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_row")
    keys = F.transform(_lines(fold(F.col(text_col))), lambda x: F.btrim(x, F.lit(WHITE_SPACE)))
    lines, _ = scratch.save(
        docs.select(F.col(id_col).alias("_id"), row, F.posexplode(keys).alias("_pos", "_key")).select(
            "_id", "_row", "_pos", (F.char_length("_key") >= min_chars).alias("_long"), *two_hashes("_key")
        )
    )
    # Written, so that the join reads both sides by a shuffle of its own and can split a hot hash.
    frequent, _ = scratch.save(
        lines.where("_long")
        .select("_h1", "_h2", "_id")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select("_h1", "_h2", F.lit(True).alias("_drop"))
    )
    verdicts = (
        lines.join(frequent, ["_h1", "_h2"], "left")
        .select("_id", "_row", F.struct("_pos", F.coalesce("_drop", F.lit(False)).alias("_drop")).alias("_line"))
        .groupBy("_id", "_row")
        # A set: repeated rows give the same positions again.
        .agg(F.array_sort(F.collect_set("_line")).alias("_verdicts"))
        .where(F.exists("_verdicts", lambda v: v["_drop"]))
        .withColumnsRenamed({"_id": "_id2", "_row": "_row2"})
    )
    kept = F.filter(
        F.zip_with("_lines", "_verdicts", lambda line, v: F.when(~v["_drop"], line)), lambda x: x.isNotNull()
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(id_col, *carry, text.alias(text_col), F.xxhash64(text).alias("_row"))
        .join(verdicts, F.col(id_col).eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), "left")
        .withColumn("_lines", _lines(F.col(text_col)))
        .select(
            id_col,
            *carry,
            F.when(F.col("_verdicts").isNull(), F.col(text_col))
            .otherwise(F.array_join(kept, "\n"))
            .alias(text_col),
            F.size("_lines").cast("bigint").alias("n_lines"),
            F.coalesce(F.size(F.filter("_verdicts", lambda v: v["_drop"])), F.lit(0)).cast("bigint").alias("n_dropped"),
        )
    )
