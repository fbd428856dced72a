"""Cutting texts into token-bounded chunks. A token is a white-space separated word."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import WS, chunk, let, no_chunks, strip, windows, words

# The separators tried from coarse to fine, and the chunk bound.
# Cutting inside words has no separator of its own: word windows end the list.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")
MAX_TOKENS = 500


def _rows(df: DataFrame, text: str, chunks: Column) -> DataFrame:
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(chunks).alias("_pos", "_chunk")).select(
        *others,
        F.col("_pos").cast("bigint").alias("chunk_ord"),
        "_chunk.chunk_text",
        F.col("_chunk.n_tokens").cast("bigint").alias("n_tokens"),
    )


def chunk_fixed(df: DataFrame, text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Windows of ``max_tokens`` words, no overlap; texts without words give no row."""
    return _rows(df, text, windows(words(F.col(text)), max_tokens))


def chunk_greedy(
    df: DataFrame,
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    separators: tuple[str, ...] = SEPARATORS,
    hard_split: bool = True,
) -> DataFrame:
    """Pack the pieces between separators into chunks as long as they fit.

    Each separator in turn works on the chunks that are still too long.
    Pieces are added while the chunk stays within ``max_tokens``; then the
    chunk is closed. A piece that is too long by itself is cut into word
    windows at once and its remainder opens the next chunk (``hard_split``),
    or else is left to the next separator, and to word windows at the end.
    Chunks are stripped and empty ones dropped.

    With ``hard_split`` the first separator already leaves no chunk above the
    bound, so the later ones have nothing to do and are not planned.
    """
    whole = F.coalesce(text, F.lit(""))
    chunks = F.array(chunk(whole, F.size(words(whole))))
    for separator in separators[:1] if hard_split else separators:
        chunks = F.flatten(F.transform(chunks, _packer(separator, max_tokens, hard_split)))
    if not hard_split:
        chunks = F.flatten(F.transform(chunks, _cutter(max_tokens)))
    return _rows(df, text, F.filter(chunks, lambda c: c.getField("chunk_text") != ""))


def _cutter(max_tokens: int) -> Callable[[Column], Column]:
    return lambda c: F.when(c.getField("n_tokens") <= max_tokens, F.array(c)).otherwise(
        windows(words(c.getField("chunk_text")), max_tokens)
    )


def _packer(separator: str, max_tokens: int, hard_split: bool) -> Callable[[Column], Column]:
    return lambda c: F.when(
        c.getField("n_tokens") > max_tokens,
        _pack(c.getField("chunk_text"), separator, max_tokens, hard_split),
    ).otherwise(F.array(chunk(strip(c.getField("chunk_text")), c.getField("n_tokens"))))


def _pack(text: Column, separator: str, max_tokens: int, hard_split: bool) -> Column:
    """One separator's pass over one too long text, as a fold over its pieces.

    The fold never counts the words of the growing chunk again. Counts add
    up, except that the visible part of a separator (the dot of '. ') becomes
    a word of its own when it follows white space; ``spaced`` tracks that.
    """
    mark = 1 if separator.strip() else 0
    pieces = F.transform(
        F.split(text, "\\Q" + separator + "\\E"),
        lambda p: F.struct(
            p.alias("s"),
            F.size(words(p)).alias("n"),
            (p.rlike(f"[{WS}]$") | (p == "")).alias("spaced") if mark else F.lit(False).alias("spaced"),
        ),
    )
    empty = F.struct(
        no_chunks().alias("done"),
        F.lit("").alias("cur"),
        F.lit(0).alias("n"),
        F.lit(False).alias("spaced"),
    )

    def closed(acc: Column) -> Column:
        done, cur = acc.getField("done"), acc.getField("cur")
        return F.when(
            cur != "", F.concat(done, F.array(chunk(strip(cur), acc.getField("n"))))
        ).otherwise(done)

    def state(done: Column, cur: Column, n: Column, spaced: Column) -> Column:
        return F.struct(
            done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"), spaced.alias("spaced")
        )

    def cut(acc: Column, p: Column) -> Column:
        # All windows but the last are full chunks; the last one stays open.
        return let(
            windows(words(p.getField("s")), max_tokens),
            lambda w: state(
                F.concat(closed(acc), F.slice(w, 1, F.size(w) - 1)),
                F.element_at(w, -1).getField("chunk_text"),
                F.element_at(w, -1).getField("n_tokens"),
                F.lit(False),
            ),
        )

    def reopened(acc: Column, p: Column) -> Column:
        return state(closed(acc), strip(p.getField("s")), p.getField("n"), F.lit(False))

    def add(acc: Column, p: Column) -> Column:
        is_open = acc.getField("cur") != ""
        gap = F.when(acc.getField("spaced"), F.lit(mark)).otherwise(F.lit(0))
        total = F.when(is_open, acc.getField("n") + gap + p.getField("n")).otherwise(p.getField("n"))
        longer = F.when(
            is_open, F.concat(acc.getField("cur"), F.lit(separator), p.getField("s"))
        ).otherwise(p.getField("s"))
        # An empty first piece leaves the chunk unopened: no separator follows it.
        spaced = p.getField("spaced") & (is_open | (p.getField("s") != ""))
        packed = state(acc.getField("done"), longer, total, spaced)
        over = reopened(acc, p)
        if hard_split:
            over = F.when(p.getField("n") > max_tokens, cut(acc, p)).otherwise(over)
        return F.when(total <= max_tokens, packed).otherwise(over)

    return F.aggregate(pieces, empty, add, closed)


def rows_to_text(df: DataFrame, name: Column | str, columns: list[str] | None = None) -> Column:
    """'Source: f' and one 'column: value' line per value that is neither missing nor blank."""
    source = F.lit(name) if isinstance(name, str) else name
    lines = [
        F.when(
            F.col(c).isNotNull() & (strip(F.col(c).cast("string")) != ""),
            F.concat(F.lit(f"{c}: "), F.col(c).cast("string")),
        )
        for c in (columns or df.columns)
    ]
    return F.concat_ws("\n", F.concat(F.lit("Source: "), source), *lines)
