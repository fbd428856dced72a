"""Documents that arrive as pages: places in the document, and chunking, without assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import WS, words


def document_pages(
    pages: DataFrame, key: str, page_no: str, text: str, pages_per_segment: int = 1024
) -> DataFrame:
    """(key, page_no, char_start, text): a document's pages with the place of each in its text.

    The text of a document is that of its pages in order, nothing in between;
    ``char_start`` counts the characters before a page, so the rows, in order,
    are the document, and any stretch of it can be cut without building it.
    The shape is the same for one page or a billion: starts are sums inside
    segments of pages and sums over segments, never a document in one place.
    Pages without text are left out. ``(key, page_no)`` is unique.
    """
    rows = pages.select(
        key,
        page_no,
        F.coalesce(text, F.lit("")).alias(text),
        F.floor(F.col(page_no) / pages_per_segment).alias("_segment"),
    ).where(F.col(text) != "")
    size = F.char_length(text).cast("bigint")
    along = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        rows.groupBy(key, "_segment")
        .agg(F.sum(size).alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(along), F.lit(0)))
        .select(key, "_segment", "_offset")
    )
    here = Window.partitionBy(key, "_segment").orderBy(page_no).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum(size).over(here), F.lit(0))
    return rows.join(segments, [key, "_segment"]).select(key, page_no, start.alias("char_start"), text)


def chunk_pages(
    pages: DataFrame,
    key: str,
    page_no: str,
    text: str,
    max_tokens: int = 500,
    pages_per_segment: int = 1024,
) -> DataFrame:
    """Word windows over a document's joined pages, without building the document.

    Gives the rows ``chunk_fixed`` gives on the joined text. Every
    page learns the number of words before it from a running sum over
    segments of pages, and sends each window its own share of the words. The
    only work done per document is a sum over its segments, so one document
    holding a large part of all pages is still spread over all tasks.

    A word cut by a page boundary belongs to one token: it is joined again.
    """
    page_words = (
        pages.select(key, page_no, F.coalesce(text, F.lit("")).alias("_text"))
        .where(F.col("_text") != "")
        .select(
            key,
            page_no,
            F.floor(F.col(page_no) / pages_per_segment).alias("_segment"),
            words(F.col("_text")).alias("_words"),
            F.col("_text").rlike(f"^[{WS}]").alias("_opens"),
            F.col("_text").rlike(f"[{WS}]$").alias("_closes"),
        )
        .withColumn("_n", F.size("_words").cast("bigint"))
    )

    # Inside a segment: does the page continue the last word of the page before it?
    here = Window.partitionBy(key, "_segment").orderBy(page_no)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    continues = F.coalesce(~F.lag("_closes").over(here) & ~F.col("_opens"), F.lit(False))
    local = page_words.withColumn("_joins", continues).withColumn(
        "_base", F.coalesce(F.sum(F.col("_n") - F.col("_joins").cast("bigint")).over(before), F.lit(0))
    )

    # Across segments: one small row each.
    ends = F.struct(page_no, "_closes")
    starts = F.struct(page_no, "_opens")
    segment = local.groupBy(key, "_segment").agg(
        F.sum(F.col("_n") - F.col("_joins").cast("bigint")).alias("_total"),
        F.min(starts).getField("_opens").alias("_first_opens"),
        F.max(ends).getField("_closes").alias("_last_closes"),
        F.min(page_no).alias("_first_page"),
    )
    along = Window.partitionBy(key).orderBy("_segment")
    along_before = along.rowsBetween(Window.unboundedPreceding, -1)
    seam = F.coalesce(~F.lag("_last_closes").over(along) & ~F.col("_first_opens"), F.lit(False))
    segment = (
        segment.withColumn("_seam", seam)
        .withColumn("_seam_n", F.col("_seam").cast("bigint"))
        .withColumn(
            "_offset",
            F.coalesce(F.sum(F.col("_total") - F.col("_seam_n")).over(along_before), F.lit(0)),
        )
        .select(key, "_segment", "_offset", "_seam", "_seam_n", "_first_page")
    )

    # A joined page starts on the word the page before it ended with. A seam
    # shifts every page of its segment except that the first page's own words
    # already start one earlier.
    placed = local.join(segment, [key, "_segment"]).select(
        key,
        page_no,
        "_words",
        "_n",
        (F.col("_joins") | (F.col("_seam") & (F.col(page_no) == F.col("_first_page")))).alias("_glued"),
        (
            F.col("_offset")
            + F.col("_base")
            - F.col("_seam_n")
            - F.col("_joins").cast("bigint")
        ).alias("_start"),
    )
    size = F.lit(max_tokens)
    first = F.floor(F.col("_start") / size)
    last = F.floor((F.col("_start") + F.col("_n") - 1) / size)
    shares = (
        placed.where(F.col("_n") > 0)
        # Exploding the expression, not a column of it: for a column Spark would
        # add a filter on its size, and compute the shares twice.
        .select(key, page_no, F.explode(_page_shares(first, last, max_tokens)).alias("_share"))
        .select(key, page_no, "_share.chunk_ord", "_share.glued", "_share.piece")
    )
    # At most max_tokens pages meet in a window, plus pages that only continue a word.
    parts = F.array_sort(F.collect_list(F.struct(page_no, "glued", "piece")))
    joined = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.concat(
                F.when((i == 0) | p.getField("glued"), "").otherwise(" "), p.getField("piece")
            ),
        ),
        "",
    )
    return shares.groupBy(key, "chunk_ord").agg(joined.alias("chunk_text"))


def _page_shares(first: Column, last: Column, max_tokens: int) -> Column:
    """Per window a page reaches: the page's words in it, and whether they continue a word."""

    def share(window: Column) -> Column:
        begin = F.greatest(window * max_tokens - F.col("_start"), F.lit(0))
        end = F.least((window + 1) * max_tokens - F.col("_start"), F.col("_n"))
        return F.struct(
            window.alias("chunk_ord"),
            (F.col("_glued") & (begin == 0)).alias("glued"),
            F.array_join(
                F.slice("_words", (begin + 1).cast("int"), (end - begin).cast("int")), " "
            ).alias("piece"),
        )

    return F.transform(F.sequence(first, last), share)
