"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import new_path

# The white space of the contracts, and the letters that are folded.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def two_hashes(*columns: Column | str) -> list[Column]:
    """128 bits in two columns, ``_h1`` and ``_h2``."""
    return [
        F.xxhash64(*columns).alias("_h1"),
        F.xxhash64(F.lit("second"), *columns).alias("_h2"),
    ]


def below(df: DataFrame, share: float, *columns: Column | str) -> DataFrame:
    """About this share of the rows, by the hash of ``columns``: a sample that is settled where rows are read."""
    return df if share >= 1 else df.where(F.xxhash64(*columns) < int((share - 0.5) * 2**64))


PAGE_BITS = 1 << 15  # of a bitmap that Spark makes
BITS_PER_KEY = 16
MAX_PAGES = 1 << 14  # 64 MB


class Scratch:
    """Intermediate tables under the shared folder, dropped when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label = spark, label

    def save(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write ``df`` and read it back: computed once, and lost with no executor."""
        path = new_path(self.spark, self.label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def key_bitmaps(keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(_page, _map): a bit for the hash of each row, one in sixteen or fewer set; and the number of pages, 1 or more.

    Pages are bounded by what a broadcast may be. Beyond that more bits are set, and less can be told apart.
    """
    pages = min(MAX_PAGES, max(1, -(-keys.count() * BITS_PER_KEY // PAGE_BITS)))
    page, bit = _bit_place(pages, *keys.columns)
    bits = keys.select(page.alias("_page"), bit.alias("_bit")).repartition("_page")
    return scratch.save(bits.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_map")))[0], pages


def _bit_place(pages: int, *columns: Column | str) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(*columns), F.lit(pages * PAGE_BITS))
    return F.floor(place / PAGE_BITS).cast("int"), (place % PAGE_BITS).cast("int")


def with_maybe(rows: DataFrame, bitmaps: tuple[DataFrame, int], *columns: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only where no key of the bitmaps has these values. No row is shuffled."""
    maps, pages = bitmaps
    page, bit = _bit_place(pages, *columns)
    byte = F.conv(F.hex(F.substr("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, bit % 8).bitwiseAND(1) == 1
    joined = rows.withColumn("_at_page", page).join(F.broadcast(maps), F.col("_at_page") == F.col("_page"), "left")
    return joined.select(*rows.columns, F.coalesce(found, F.lit(False)).alias("_maybe"))


def key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of the first column from batches sorted by it.

    A run that goes on in the next batch is held back until it ends, so every
    table given holds each of its keys completely.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        last = keys[batch.num_rows - 1]
        if held and held[-1].column(0)[held[-1].num_rows - 1] == last:
            held.append(batch)
            continue
        start = _last_run(keys)
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _last_run(keys: pa.Array) -> int:
    """Where the run of the last key begins in a sorted array."""
    last, low, high = keys[len(keys) - 1], 0, len(keys) - 1
    while low < high:
        middle = (low + high) // 2
        if keys[middle] == last:
            high = middle
        else:
            low = middle + 1
    return low
