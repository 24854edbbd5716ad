"""CSV scan, file inventory, report sink."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.patterns import CSV_MISSING
from .csv_records import records


INFERRED = ("bigint", "double", "boolean", "timestamp")


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV that keeps line breaks, quotes and outer white space."""
    (
        df.write.mode("overwrite")
        .option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a headed CSV; fields that spell a missing value become NULL.

    Without a schema a column gets the first of ``INFERRED`` that all its values present can be cast to, else string,
    which costs a pass over the records. Fields may hold line breaks; a file is read by many tasks all the same, and its
    lines are written to the shared folder once (``csv_records``).
    """
    rows = records(spark, path)
    if schema is None:
        schema = StructType([StructField(n, StringType()) for n in _header(rows)])
        typed = _typed
    else:
        typed = lambda df: df
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    fields = rows.where("not header").select(F.from_csv("record", kinds, {"quote": '"', "escape": '"'}).alias("r"))
    return typed(fields.select(*[
        F.when(~F.col("r")[f.name].isin(*CSV_MISSING), F.col("r")[f.name]).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col("r")[f.name].alias(f.name)
        for f in schema.fields
    ]))


def _header(rows: DataFrame) -> list[str]:
    """The column names in the first file; a column without a name gets one by its place."""
    first = rows.where("header").orderBy("file").select("record").first()
    if first is None:
        return []
    return [name or f"_c{i}" for i, name in enumerate(next(csv.reader(io.StringIO(first["record"], newline=""))))]


def _typed(df: DataFrame) -> DataFrame:
    """Columns of strings in the narrowest type that holds all of them; one pass for all columns."""
    fits = df.agg(*[
        F.array(*[F.every(F.col(c).isNull() | F.col(c).try_cast(t).isNotNull()) for t in INFERRED]).alias(c) for c in df.columns
    ], *[F.count(c).alias(f"n {i}") for i, c in enumerate(df.columns)]).first()
    kinds = [
        next((t for t, ok in zip(INFERRED, fits[i] or []) if ok), "string") if fits[len(df.columns) + i] else "string"
        for i in range(len(df.columns))
    ]
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in zip(df.columns, kinds)])


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder``; the contents are pruned from the scan."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", "length", "modificationTime")
    )


def write_report(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Save a report as Parquet."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
