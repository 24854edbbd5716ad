"""Exact ranks by a hashed order, without one big sort and without a single-task window.

Rows are ordered by an md5 hex digest. Digests are uniform, so their first hex digits cut any group
into even buckets that are already in order: the rank of a row is the number of rows in the
buckets before its own plus its place inside the bucket. Bucket counts come from one partial
aggregation. Buckets have as many levels of ``DIGITS`` digits as it takes to keep each below
``BUCKET_ROWS`` rows, and what stands before a bucket is summed level by level among the ``16 ** DIGITS``
buckets that share a parent. So a group of any size is ranked by as many tasks as it fills, and no
task sees more than a bucket of rows or one family of counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 3
BUCKET_ROWS = 1 << 20
MOST_LEVELS = 32 // DIGITS


def hashed_order(seed: int, *keys: str) -> Column:
    """md5 of ``seed:key1:key2...``: the same in every engine and for every partitioning. A key must not be NULL."""
    parts = [F.coalesce(F.col(k).cast("string"), F.raise_error(F.lit(f"{k} is NULL")).cast("string")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def levels(df: DataFrame, groups: list[str]) -> int:
    """How many levels of buckets the largest group needs; a row for each group of a bounded number, or a count."""
    sizes = df.groupBy(*groups).agg(F.count("*").alias("n"))
    n, depth = sizes.agg(F.max("n")).first()[0] or 0, 1
    while n > BUCKET_ROWS * 16 ** (DIGITS * depth) and depth < MOST_LEVELS:
        depth += 1
    return depth


def bucket_counts(df: DataFrame, order: str, groups: list[str], depth: int = 1) -> DataFrame:
    """Rows per bucket with the number of rows in the buckets before it, per group; buckets of ``depth`` levels."""
    parts = [f"digits_{i}" for i in range(depth)]
    counts = df.groupBy(*groups, *[
        F.substring(order, 1 + DIGITS * i, DIGITS).alias(p) for i, p in enumerate(parts)]).agg(F.count("*").alias("bucket_n"))
    if depth == 1:
        upto = F.sum("bucket_n").over(Window.partitionBy(*groups).orderBy(parts[0]))
        return counts.select(*groups, F.col(parts[0]).alias("bucket"), "bucket_n", (upto - F.col("bucket_n")).alias("before"))
    before = []
    for i, part in enumerate(parts):
        # rows of the siblings before, among the buckets that share the digits above
        family = [*groups, *parts[:i]]
        own = counts.groupBy(*family, part).agg(F.sum("bucket_n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*family).orderBy(part))
        before.append(own.select(*family, part, (upto - F.col("n")).alias(f"before_{i}")))
    found = reduce(lambda a, i: a.join(before[i], [*groups, *parts[:i + 1]]), range(depth), counts)
    return found.select(
        *groups, F.concat(*parts).alias("bucket"), "bucket_n", reduce(lambda a, b: a + b, [F.col(f"before_{i}") for i in range(depth)]).alias("before"))


def with_rank(df: DataFrame, order: str, groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row by ``order`` inside its group.

    ``order`` must be unique inside a group. ``df`` is read three times, once to count its groups; stage it when it is
    costly, and hand in keys only, wide columns are better joined afterwards.
    """
    groups = groups or []
    depth = levels(df, groups)
    offsets = bucket_counts(df, order, groups, depth).drop("bucket_n")
    inside = Window.partitionBy(*groups, "bucket").orderBy(order)
    placed = (
        df.withColumn("bucket", F.substring(order, 1, DIGITS * depth))
        .withColumn("in_bucket", F.row_number().over(inside) - 1)
    )
    # the rows already lie sorted by group and bucket, so a merge moves the few offsets only
    joined = placed.join(offsets.hint("merge"), [*groups, "bucket"])
    return joined.withColumn(name, F.col("before") + F.col("in_bucket")).drop("bucket", "in_bucket", "before")


def cut_points(df: DataFrame, order: str, group: str, cuts: DataFrame) -> DataFrame:
    """The order value of the ``cut_rank``-th row (1-based) of each group: ``(group, cut, cut_value)``.

    ``cuts`` holds ``(group, cut, cut_rank)``: a few rows for each of few groups, made from a checked table.
    Only the buckets that hold a cut are ranked; every other row is just counted.
    """
    depth = levels(df, [group])
    wanted = (
        bucket_counts(df, order, [group], depth).join(F.broadcast(cuts), group)
        .where((F.col("before") < F.col("cut_rank")) & (F.col("cut_rank") <= F.col("before") + F.col("bucket_n")))
        .select(group, "bucket", "cut", (F.col("cut_rank") - F.col("before")).alias("local_rank"))
    )
    band = df.select(group, order, F.substring(order, 1, DIGITS * depth).alias("bucket")).join(F.broadcast(wanted), [group, "bucket"])
    inside = Window.partitionBy(group, "cut").orderBy(order)
    return (
        band.withColumn("rn", F.row_number().over(inside)).where(F.col("rn") == F.col("local_rank"))
        .select(group, "cut", F.col(order).alias("cut_value"))
    )
