"""File discovery and CSV loading."""

from __future__ import annotations

import functools
import operator
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.text import table_name

# The suffixes ingestion recognises, matched with case, in one flat folder.
KNOWN_SUFFIXES = (".pdf", ".csv")


def discover_files(
    spark: SparkSession, directory: str, suffixes: tuple[str, ...] = KNOWN_SUFFIXES
) -> DataFrame:
    """(file_name, file_type, length) of the recognised files.

    Only the listing is read: ``content`` is never selected, so the scan
    prunes it. A missing directory is an error; no match gives no rows. Scans
    leave out files without a byte, so those are taken from the listing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(directory)
        .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )
    empty = _empty_files(spark, directory)
    if empty:
        files = files.unionByName(spark.createDataFrame([(name, 0) for name in empty], files.schema))
    kind = F.coalesce(
        *[
            F.when(F.endswith("file_name", F.lit(s)), F.lit(s.removeprefix(".").upper()))
            for s in suffixes
        ]
    )
    return files.withColumn("file_type", kind).where(F.col("file_type").isNotNull())


def _empty_files(spark: SparkSession, directory: str) -> list[str]:
    """Names of the files of a flat folder that have no byte, but for hidden ones."""
    place = spark._jvm.org.apache.hadoop.fs.Path(directory)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = [f for f in store.listStatus(place) if f.getLen() == 0 and f.isFile()]
    return [n for n in (f.getPath().getName() for f in listed) if n[0] not in "._"]


class BadHeader(ValueError):
    """A declared column is not in the file's header."""


def read_csv(spark: SparkSession, path: str, schema: StructType | None) -> DataFrame:
    """A header CSV, columns by name; without a declared schema every column is text.

    Fields are read as text and converted, so a header in another order, or
    with more columns, gives the right values; a value that does not convert
    becomes NULL. A declared column that the header lacks is an error.
    """
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if schema is None:
        return rows
    missing = [f.name for f in schema if f.name not in rows.columns]
    if missing:
        raise BadHeader(f"{path} lacks {', '.join(missing)}")
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class Loaded:
    """What became of a CSV file: rows, values that did not convert, or why it failed."""

    rows: int = 0
    bad_values: int = 0
    error: str | None = None


def load_csv(spark: SparkSession, path: str, schema: StructType | None, target: str) -> Loaded:
    """Load a header CSV as a Parquet table, replacing what was there once it is read to its end.

    Rows, and values that did not convert, are counted by the write itself, so
    the file is read once. It goes to a new folder first: a file that cannot
    be read, at the start or in the middle, leaves the old table as it is.
    """
    seen, draft = Observation(), f"{target}.{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows, bad = read_csv(spark, path, schema), F.lit(0)
        if schema is not None:
            # A value is lost if there is text but no value of the declared type.
            fields = read_csv(spark, path, None)
            lost = [F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in schema]
            bad = F.coalesce(F.sum(functools.reduce(operator.add, [x.cast("int") for x in lost])), F.lit(0))
            rows = fields.observe(seen, F.count(F.lit(1)).alias("n"), bad.alias("bad")).select(
                *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema]
            )
        else:
            rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), bad.alias("bad"))
        rows.write.parquet(draft)
    # Reading a header fails with the JVM's own error, reading rows with Spark's.
    except (PySparkException, Py4JJavaError, BadHeader) as problem:
        store.delete(files.Path(draft), True)
        return Loaded(error=str(problem).splitlines()[0])
    store.delete(files.Path(target), True)
    store.mkdirs(files.Path(target).getParent())
    if not store.rename(files.Path(draft), files.Path(target)):
        return Loaded(error=f"{target} could not be replaced")
    return Loaded(seen.get["n"], seen.get["bad"])


def with_table_names(files: DataFrame) -> DataFrame:
    """Add the table each listed file loads into."""
    return files.withColumn("table_name", table_name(F.col("file_name")))
