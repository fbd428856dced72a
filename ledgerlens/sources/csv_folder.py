"""A flat folder of CSV files as tables: files with the same header are read together."""

from __future__ import annotations

import csv
import functools
import operator
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.functions.text import table_name
from ledgerlens.sources.files import Loaded, discover_files, with_table_names


def _file_name() -> Column:
    """The name of the file a row comes from, as the file system has it; the metadata has it as part of an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, directory: str) -> DataFrame:
    """(file_name, header): the first line of every CSV file that has one, in one job."""
    lines = (
        spark.read.option("pathGlobFilter", "*.csv").text(directory)
        .select("value", _file_name().alias("file_name"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
        # A file's first block is read by one task, line by line.
        .where("_start = 0")
    )
    return lines.groupBy("file_name").agg(F.min_by("value", "_at").alias("header"))


def _columns(header: str) -> list[str]:
    """Names of the columns; those that repeat or are missing are told apart by their place, as Spark does."""
    names = next(csv.reader([header.removeprefix("﻿")]), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _typed(rows: DataFrame, schema: StructType | None) -> list:
    if schema is None:
        return [F.col(f"`{c}`") for c in rows.columns]
    return [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]


def load_csv_folder(
    spark: SparkSession, directory: str, target: str, schemas: dict[str, StructType]
) -> dict[str, tuple[str, Loaded]]:
    """{file: (table, what became of it)}: every ``.csv`` of a folder as ``target/table``, replacing what was there.

    One job reads the headers. Files that have the same header and the same
    declared schema are then read and written together, a folder per table, so
    the number of jobs goes with the number of different headers. Columns go by
    name; a value that does not convert becomes NULL and is counted. What
    cannot be read is found by halving: the other files of its group load.
    Tables change only when their rows are written whole. Of files whose names
    give the same table the first loads and the others are refused. Listings
    and headers come to the driver, rows do not.
    """
    listed = with_table_names(discover_files(spark, directory).where(F.col("file_type") == "CSV"))
    found = listed.select("file_name", "table_name").join(headers(spark, directory), "file_name", "left").orderBy("file_name").collect()
    out: dict[str, tuple[str, Loaded]] = {}
    owner: dict[str, str] = {}
    groups: dict[tuple[str, str | None], list[str]] = {}
    for row in found:
        first = owner.setdefault(row.table_name, row.file_name)
        if first != row.file_name:
            out[row.file_name] = row.table_name, Loaded(error=f"{first} is loaded as {row.table_name} already")
        elif row.header is None or not _columns(row.header):
            out[row.file_name] = row.table_name, Loaded(error=f"{row.file_name} has no header")
        else:
            groups.setdefault((row.header, row.table_name if row.table_name in schemas else None), []).append(row.file_name)
    tables = {name: table for table, name in owner.items()}
    for (header, declared), names in groups.items():
        columns, schema = _columns(header), schemas.get(declared) if declared else None
        lacks = [f.name for f in schema if f.name not in columns] if schema else []
        if lacks:
            result = {n: Loaded(error=f"{n} lacks {', '.join(lacks)}") for n in names}
        else:
            result = _load_group(spark, directory, target, columns, schema, names)
        out |= {n: (tables[n], x) for n, x in result.items()}
    return out


def _load_group(
    spark: SparkSession, directory: str, target: str, columns: list[str], schema: StructType | None, names: list[str]
) -> dict[str, Loaded]:
    """Files with one header; if they cannot be read together, each half by itself."""
    files = spark._jvm.org.apache.hadoop.fs
    draft = files.Path(f"{target}/_draft-{uuid.uuid4().hex}")
    store = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [f"{directory.rstrip('/')}/{_escaped(n)}" for n in names]
    fields = StructType([StructField(c, StringType()) for c in columns])
    name = table_name(_file_name())
    try:
        rows = spark.read.schema(fields).option("header", True).csv(paths)
        rows.select(*_typed(rows, schema), name.alias("_table")).write.partitionBy("_table").parquet(draft.toString())
        bad = {}
        if schema is not None:
            # Text that has no value of the declared type.
            lost = [F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull() for f in schema]
            sums = rows.select("*", _file_name().alias("_file")).groupBy(F.col("_file").alias("n")).agg(F.sum(functools.reduce(operator.add, [x.cast("int") for x in lost])).alias("bad"))
            bad = {r.n: r.bad for r in sums.collect()}
        written = spark.read.schema("_table string").parquet(draft.toString()).groupBy("_table").count().collect()
    # Reading a header fails with the JVM's own error, reading rows with Spark's.
    except (PySparkException, Py4JJavaError) as problem:
        store.delete(draft, True)
        if len(names) == 1:
            return {names[0]: Loaded(error=str(problem).splitlines()[0])}
        half = len(names) // 2
        return _load_group(spark, directory, target, columns, schema, names[:half]) | _load_group(
            spark, directory, target, columns, schema, names[half:]
        )
    counts = {r["_table"]: r["count"] for r in written}
    out = {}
    for file in names:
        table = _table_of(file)
        place, own = files.Path(f"{target}/{table}"), files.Path(draft, f"_table={_path_part(spark, table)}")
        store.delete(place, True)
        if table not in counts:
            # A header and no rows: a table all the same.
            spark.createDataFrame([], schema or fields).write.parquet(place.toString())
        elif not store.rename(own, place):
            out[file] = Loaded(error=f"{target}/{table} could not be replaced")
            continue
        out[file] = Loaded(counts.get(table, 0), int(bad.get(file) or 0))
    store.delete(draft, True)
    return out


def _table_of(file: str) -> str:
    return file.replace(".csv", "").replace("-", "_").replace(" ", "_")


def _path_part(spark: SparkSession, value: str) -> str:
    """A value as Spark writes it into the name of a partition's folder."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _escaped(name: str) -> str:
    """A file name as a path pattern that matches nothing else."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in name)
