"""Profile of a posts table: counts, summaries, frequencies, cross-tables, histograms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import text_length, word_count
from ..session import checked_small
from .labels import MAX_CLASSES
from .selection import values_at

QUARTILES = (0.25, 0.5, 0.75)
TIMES = (T.DateType, T.TimestampType)
FIXED_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
               T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8}


def has_columns(df: DataFrame, *names: str) -> bool:
    """Whether a report section applies; answered from the schema, without a job."""
    return all(n in df.columns for n in names)


def _is_missing(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def basic(df: DataFrame, measured: tuple[str, ...] = ()) -> DataFrame:
    """Rows, columns and data size in MB: bytes of the strings plus the width of the other columns.

    Columns in ``measured`` hold the bytes of a string instead of the string, so that it need not go through a join.
    """
    sizes = [
        F.coalesce(F.col(f.name), F.lit(0)) if f.name in measured
        else F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, T.StringType)
        else F.lit(FIXED_WIDTH.get(type(f.dataType), 8))
        for f in df.schema.fields
    ]
    total = F.sum(reduce(lambda a, b: a + b, sizes).cast("long"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.round(total / (1024.0 * 1024.0), 6).alias("size_mb"),
    )


def schema_report(df: DataFrame) -> DataFrame:
    """Column names and types with the count of values present, in one pass."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.when(~_is_missing(f), 1)).alias(f.name) for f in fields])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).alias("n_present"))
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


def missing(df: DataFrame) -> DataFrame:
    """Missing count and percentage of each column that misses any; one pass for all columns."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("__rows"),
        *[F.count(F.when(_is_missing(f), 1)).alias(f.name) for f in fields],
    )
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("missing_count")) for f in fields]
    return (
        counts.select("__rows", F.inline(F.array(*rows)))
        .where("missing_count > 0")
        .select("column_name", "missing_count",
                F.round(F.col("missing_count") / F.col("__rows") * 100.0, 6).alias("percentage"))
    )


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values by count, most frequent first; missing values are left out."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def shares(df: DataFrame, column: str) -> DataFrame:
    """Percentage of each value among the values present (window over the few counted rows)."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counted.select(column, F.round(F.col("n") / total * 100.0, 6).alias("percentage"))


def with_text_measures(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumns({"text_length": text_length(F.col(column)), "word_count": word_count(F.col(column))})


def text_length_stats(df: DataFrame, column: str = "text") -> DataFrame:
    lengths = df.select(text_length(F.col(column)).alias("n"), word_count(F.col(column)).alias("w"))
    return lengths.agg(
        F.round(F.avg("n"), 6).alias("avg_text_length"),
        F.round(F.avg("w"), 6).alias("avg_word_count"),
        F.max("n").alias("max_text_length"),
        F.min("n").alias("min_text_length"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of ``rows`` by ``columns``; pairs with a missing side are left out.

    The known values are given, which spares the job that would look them up.
    """
    return (
        df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
        .groupBy(rows)
        .agg(*[F.count(F.when(F.col(columns) == v, 1)).alias(v) for v in values])
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, a missing one included, with the number of values present beside each."""
    found = df.select(column).distinct()
    return found.select(column, F.count(column).over(Window.partitionBy()).alias("n_classes"))


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, measure: Column, bins: int) -> DataFrame:
    """Equal-width bins over an integer measure such as a text length; the last bin is closed.

    The text is read once: equal lengths are counted first, and the number of different lengths
    is bounded by the longest text, so range, bins and totals come from that small table.
    """
    counted = df.select(measure.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    ranged = counted.select("v", "n", F.min("v").over(whole).cast("double").alias("a"),
                            F.max("v").over(whole).cast("double").alias("b"))
    # one single value: the range is widened by a half on both sides
    ranged = ranged.select(
        "v", "n",
        F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
        F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width).cast("int"))
    filled = ranged.groupBy("lo", "hi", place.alias("bin")).agg(F.sum("n").alias("n"))
    # the range is one pair of numbers, so this collects at most ``bins`` rows; no value at all still gives every bin
    per_range = filled.agg(
        F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found")
    )
    return per_range.select("lo", "hi", "found", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin",
        F.round(F.col("lo") + F.col("bin") * width, 6).alias("bin_start"),
        F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("bin_end"),
        F.coalesce(F.try_element_at("found", "bin"), F.lit(0).cast("long")).alias("n"),
    )


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first rows in key order (a table has no order of its own)."""
    return df.orderBy(key).limit(n)


def samples_per_class(df: DataFrame, column: str, text: str, key: str, n: int = 2, width: int = 100,
                      texts: DataFrame | None = None) -> DataFrame:
    """First ``n`` texts of each class, cut to ``width`` characters with dots behind.

    Only keys are ranked; the texts of the few winners are fetched afterwards, from ``texts`` where the
    class of a post is the outcome of a join the texts need not go through.
    """
    keyed = df.where(F.col(column).isNotNull()).select(column, key)
    order = Window.partitionBy(column).orderBy(key)
    winners = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    few = checked_small(winners, n * MAX_CLASSES, "samples")
    # their keys go into the scan, which can skip whatever cannot hold them
    keys = [r[key] for r in few.select(key).collect()]
    lookup = (df if texts is None else texts).select(key, text).where(F.col(key).isin(keys))
    fetched = lookup.join(F.broadcast(few), key)
    return fetched.select(
        F.upper(column).alias(column), "rank", key,
        F.concat(F.substring(text, 1, width), F.lit("...")).alias("sample"),
    )


def _describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, exact at any size.

    One pass takes the moments; the values around the quartile ranks are then found by counting passes (``selection``),
    without a window or a sort over values. NaN is a missing value, and times count in seconds since 1970 and have no
    ``std``. A few numbers per column go through the driver.
    """
    times = {f.name for f in df.schema.fields if isinstance(f.dataType, TIMES)}
    df = df.select(*[
        F.when(~_is_missing(f), (F.col(f.name).cast("timestamp") if f.name in times else F.col(f.name)).cast("double")).alias(f.name)
        for f in df.schema.fields if f.name in columns])
    moments = df.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c)
        for c in columns]).first()
    places = {c: [(moments[c]["count"] - 1) * q for q in QUARTILES] for c in columns if moments[c]["count"]}
    wanted = {c: (moments[c]["count"], moments[c]["min"], moments[c]["max"], [r for p in at for r in (math.floor(p), math.ceil(p))])
              for c, at in places.items()}
    found = values_at(df, wanted)

    def quartile(c: str, place: float) -> float:
        low, high = found[c, math.floor(place)], found[c, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    rows = [(c, *moments[c][:2], None if c in times else moments[c][2], *moments[c][3:5],
             *([quartile(c, p) for p in places[c]] if c in places else [None] * len(QUARTILES))) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, count bigint, mean double, std double, min double, max double, p25 double, p50 double, p75 double")


def _describe_strings(df: DataFrame, columns: list[str], key: str, texts: DataFrame | None = None) -> DataFrame:
    """count, unique, top and freq of string columns; among equal counts the first seen by ``key``.

    Values are grouped by a 256-bit digest, so digests and keys are shuffled, never the texts, in one
    pass. Its outcome, one row per column, goes through the driver, and the winning texts are then read
    by their keys, which the scan can look up.
    """
    given = [c for c in texts.columns if c in columns] if texts is not None else []
    hashed = df.select(F.col(key).alias("k"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 (F.col(c) if c in given else F.sha2(F.col(c).cast("string"), 256)).alias("digest")) for c in columns
    ])))
    counted = hashed.groupBy("column_name", "digest").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))
    present = F.col("digest").isNotNull()
    # larger counts first, then smaller keys; for whole numbers, of at most 19 digits, as one number
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        order = F.col("n").cast("decimal(17,0)") * F.lit("1" + "0" * 20).cast("decimal(21,0)") - F.col("first_key")
        first = F.max_by("first_key", F.when(present, order))
    else:
        first = F.min(F.when(present, F.struct((-F.col("n")).alias("less"), "first_key"))).getField("first_key")
    summary = counted.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.count("digest").alias("unique"),
        F.max(F.when(present, F.col("n"))).alias("freq"),
        first.alias("first_key"),
    ).collect()
    spark = df.sparkSession
    shape = f"column_name string, count bigint, unique bigint, freq bigint, first_key {kind.simpleString()}"
    rows = [(r["column_name"], r["count"], r["unique"], r["freq"], r["first_key"] if r["freq"] else None) for r in summary]
    keys = sorted({r[4] for r in rows if r[4] is not None})
    def tops(source: DataFrame, names: list[str]) -> DataFrame:
        return source.where(F.col(key).isin(keys)).select(F.col(key).alias("k"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("top")) for c in names
        ])))

    own = [c for c in columns if c not in given]
    values = reduce(DataFrame.unionByName, [*([tops(df, own)] if own else []), *([tops(texts, given)] if given else [])])
    named = spark.createDataFrame(rows, shape)
    # as many rows as columns
    joined = named.join(F.broadcast(values), (F.col("k") == F.col("first_key")) & (F.col("c") == F.col("column_name")), "left")
    return joined.select("column_name", "count", "unique", "top", "freq")


def describe(df: DataFrame, key: str, texts: DataFrame | None = None) -> DataFrame:
    """The summary of every column: strings and booleans get unique/top/freq, numbers and times moments and quartiles.

    String columns that ``texts`` has beside the key hold sha2 digests of 256 bits in ``df``, so that they need not
    go through a join; their few winning values are read from ``texts``.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, *TIMES))]
    parts = []
    if strings:
        parts.append(_describe_strings(df, strings, key, texts))
    if numbers:
        parts.append(_describe_numeric(df, numbers))
    none = df.sparkSession.createDataFrame([], "column_name string, count bigint")
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts or [none])
    wanted = {"column_name": "string", "count": "bigint", "unique": "bigint", "top": "string", "freq": "bigint",
              "mean": "double", "std": "double", "min": "double", "p25": "double", "p50": "double",
              "p75": "double", "max": "double"}
    return both.select(*[
        F.round(c, 6).alias(c) if t == "double" and c in both.columns
        else (F.col(c) if c in both.columns else F.lit(None).cast(t).alias(c))
        for c, t in wanted.items()
    ])
