"""Text columns: words, cleaning, windows, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and \s treat as white space,
# once as a regex class body and once as the characters themselves. Java's \s
# covers ASCII only; one property test is much faster than a list of ranges.
WS = r"\p{IsWhite_Space}\x1c-\x1f"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: what counts as a word character next to a page number.
WORD = r"[\p{L}\p{N}_]"
# The noise extraction leaves in chunks.
SENTINELS = ("<s>", "</s>")
GLYPH_CODE = r"/g\p{Nd}+"
# The check before the number comes after its first digit, so that only digits pay for it.
PAGE_OF_PAGES = (
    rf"\p{{Nd}}(?<!{WORD}\p{{Nd}})\p{{Nd}}*[{WS}]+of[{WS}]+\p{{Nd}}+(?!{WORD})"
)
# Runs of white space other than the single spaces that stay as they are.
UNEVEN_SPACE = f"[{WS}&&[^ ]][{WS}]*| [{WS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Inside a higher-order function an expression is evaluated at every use, so
    splitting a text in a loop body would split it once per iteration.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def words(col: Column) -> Column:
    """White-space separated words; the token unit of the chunkers."""
    return F.array_remove(F.split(col, f"[{WS}]+"), "")


def token_count(col: Column) -> Column:
    return F.size(words(col)).cast("bigint")


def terms(col: Column) -> Column:
    """Lower-cased runs of letters and digits; the index unit of lexical search."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


def clean_text(col: Column) -> Column:
    """Drop sentinels, glyph codes and 'n of m' page marks, then squeeze white space."""
    for sentinel in SENTINELS:
        col = F.replace(col, F.lit(sentinel), F.lit(""))
    col = F.regexp_replace(col, GLYPH_CODE, "")
    col = F.regexp_replace(col, PAGE_OF_PAGES, "")
    return strip(F.regexp_replace(col, UNEVEN_SPACE, " "))


def windows(word_array: Column, max_tokens: int) -> Column:
    """Consecutive windows of at most ``max_tokens`` words, each joined by one space.

    An array of ``(chunk_text, n_tokens)``.
    """
    return let(
        word_array,
        lambda w: F.when(
            F.size(w) > 0,
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 1, F.lit(max_tokens)),
                lambda start: chunk(
                    F.array_join(F.slice(w, start + 1, max_tokens), " "),
                    F.least(F.size(w) - start, F.lit(max_tokens)),
                ),
            ),
        ).otherwise(no_chunks()),
    )


def chunk(text: Column, n_tokens: Column) -> Column:
    return F.struct(text.alias("chunk_text"), n_tokens.cast("int").alias("n_tokens"))


def no_chunks() -> Column:
    return F.array().cast("array<struct<chunk_text:string,n_tokens:int>>")


def excerpt(col: Column, width: int = 500) -> Column:
    """The display form of a keyword hit; the dots are added even when nothing was cut."""
    return F.concat(F.substring(col, 1, width), F.lit("..."))


def shown(col: Column) -> Column:
    """A value as text in a result line; a missing value reads NULL."""
    return F.coalesce(col.cast("string"), F.lit("NULL"))


def strip_sql_fence(col: Column) -> Column:
    """Remove Markdown fences around logged SQL text."""
    col = F.regexp_replace(col, rf"(?md)^```sql[{WS}]*", "")
    return strip(F.regexp_replace(col, rf"(?md)```[{WS}]*$", ""))


def table_name(filename: Column) -> Column:
    """Table name of a CSV file: no '.csv', '-' and ' ' become '_'."""
    return F.translate(F.replace(filename, F.lit(".csv"), F.lit("")), "- ", "__")
