"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its content says so, and its recipe is the ordered list of its
chunks' identifiers. Two texts are equal if their recipes are, so documents meet as
short lists of numbers; of the texts only distinct chunks are moved, once, to verify
that an identifier stands for one chunk and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch

LEAST = 1024  # characters of a chunk before a boundary counts
MOST = 8192  # characters after which a chunk ends without one
# A boundary is a window of four characters, or the end of a sentence where words are not spaced.
BOUNDARY = "[aeiou][nrst] [a-m]|[。！？।۔።]"


def one_space(text: Column) -> Column:
    """Every run of ASCII white space as one space.

    Single characters are replaced first, which needs no regular expression;
    only texts that then hold two spaces in a row are searched for runs.
    """
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "  +", " ")).otherwise(text)


def content_chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order; joined they are the text again.

    From where a chunk begins, it ends behind the first boundary that leaves
    it ``least`` characters long, or after ``most`` characters, or with the
    text. Where it ends depends on what follows its beginning only, so texts
    that share a passage fall into step there.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?:{BOUNDARY})|.{{1,{most}}}"), F.lit(0))


def exact_dedup(
    docs: DataFrame,
    least: int = LEAST,
    most: int = MOST,
    hash_bits: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256): every row, and the row that stays of those with its text.

    Texts are equal if they are identical with each run of ASCII white space
    as one space. Of equal texts the row with the smallest id stays.

    A chunk's identifier is its hash and, where different chunks share a
    hash, its place among them in text order. Hashes of ``hash_bits`` bits
    are verified: distinct chunks are compared byte by byte, and only if a
    hash stands for two are the rows written with their chunks, to number
    those. Copies meet as partial counts, so a group that holds a third of
    all rows is one row per task, and only groups of two or more are joined
    back to the rows, by a join that adaptive execution may split.

    A missing text is empty. A text of white space alone equals others of
    the kind, not the empty one. Rows without an id come after all ids; a
    group of such rows has no ``keep_id``. Rows that repeat an id and a text
    are each returned, and one of them stays. Very long texts are cut into as
    many chunks as it takes; only their recipes are shuffled by row. An empty
    table gives an empty table. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select(F.col(id_col).alias("_id"), one_space(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    pieces = content_chunks(F.col("_text"), least, most)

    def hashed(chunk: Column) -> Column:
        return F.xxhash64(chunk) if hash_bits == 64 else F.xxhash64(chunk).bitwiseAND((1 << hash_bits) - 1)

    known = ("_id", F.monotonically_increasing_id().alias("_row"), F.sha2("_text", 256).alias("text_sha256"))
    distinct = texts.select(F.explode(pieces).alias("_chunk")).select(hashed(F.col("_chunk")).alias("_hash"), "_chunk").distinct()
    shared, _ = scratch.save(distinct.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    if shared.isEmpty():
        recipe = F.transform(pieces, hashed).alias("_recipe")
        rows, _ = scratch.save(texts.select(*known, recipe))
    else:
        rows = _numbered(texts.select(*known, pieces.alias("_chunks")), shared, hashed, scratch)
    # The digest comes first, so that sorts compare numbers and whole lists only where those agree.
    rows = rows.withColumn("_digest", F.xxhash64("_recipe"))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_first")
    groups, _ = scratch.save(
        rows.groupBy("_digest", "_recipe").agg(first, F.count(F.lit(1)).alias("_size")).where("_size > 1")
    )
    alone = F.col("_size").isNull()
    return rows.join(groups, ["_digest", "_recipe"], "left").select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("_first._row"))).alias("kept"),
        "text_sha256",
    )


def _numbered(rows: DataFrame, shared: DataFrame, hashed, scratch: Scratch) -> DataFrame:
    """Rows with recipes of (hash, number) as flat lists; chunks that share a hash get numbers from 1 on."""
    rows, _ = scratch.save(rows)
    parts = rows.select("_row", F.posexplode("_chunks").alias("_pos", "_chunk")).withColumn("_hash", hashed(F.col("_chunk")))
    doubtful, _ = scratch.save(parts.join(shared, "_hash", "left_semi"))
    numbers = (
        doubtful.select("_hash", "_chunk").distinct()
        .withColumn("_number", F.row_number().over(Window.partitionBy("_hash").orderBy("_chunk")).cast("bigint"))
    )
    settled = (
        doubtful.join(numbers, ["_hash", "_chunk"])
        .groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_number"))).alias("_numbers"))
    )
    number = lambda i: F.coalesce(F.try_element_at("_numbers", i), F.lit(0).cast("bigint"))
    recipe = F.flatten(F.transform("_chunks", lambda c, i: F.array(hashed(c), number(i))))
    done, _ = scratch.save(
        rows.join(settled, "_row", "left").select("_id", "_row", "text_sha256", recipe.alias("_recipe"))
    )
    return done
