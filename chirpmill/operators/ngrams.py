"""Frequent runs of words, counted exactly and level by level.

A run of n words can only be frequent if both runs of n - 1 words in it are. So each level numbers the frequent runs of the
level below, and a run is a pair of neighbouring numbers: places where one of the two is missing are not counted at all, and
the tables shrink from level to level. A level is three steps: neighbours by text, counts by pair with partial sums, numbers
back to the places. It is written, so a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SIZES = (2, 3, 4, 5)
LEAST = 5
#: Runs of each size that a model keeps.
MOST = 1 << 14


def frequent(df: DataFrame, sequence: str = "sequence", keys: tuple[str, ...] = ("post_id",), times: str | None = None,
             sizes: tuple[int, ...] = SIZES, least: int = LEAST, unknown: int = 1) -> DataFrame:
    """``(size, ids, n)``: every run of some size of known ids that stands ``least`` times in the texts or more.

    ``times`` says how often a row counts; ``keys`` name a row. The id ``unknown`` is in no run.
    """
    often = (F.col(times) if times else F.lit(1)).cast("long")
    at = stage(
        df.select(*keys, often.alias("often"), F.posexplode(sequence).alias("pos", "run")).where(F.col("run") != unknown)
        .select(*keys, "often", "pos", F.col("run").cast("long").alias("run"), F.array(F.col("run").cast("int")).alias("ids")), "runs-1")
    found = None
    behind = Window.partitionBy(*keys).orderBy("pos")
    for size in range(2, max(sizes) + 1):
        after = F.lead(F.struct("pos", "run", "ids")).over(behind)
        pairs = stage(
            at.withColumn("after", after).where("after.pos = pos + 1")
            .select(*keys, "often", "pos", F.col("run").alias("x"), F.col("after.run").alias("y"),
                    F.concat("ids", F.slice("after.ids", -1, 1)).alias("ids")), f"pairs-{size}")
        counts = stage(
            pairs.groupBy("x", "y").agg(F.sum("often").alias("n"), F.first("ids").alias("ids")).where(F.col("n") >= least)
            .withColumn("run", F.monotonically_increasing_id()), f"frequent-{size}")
        if size in sizes:
            own = counts.select(F.lit(size).alias("size"), "ids", "n")
            found = own if found is None else found.unionByName(own)
        if size < max(sizes):
            at = stage(pairs.join(counts.select("x", "y", "run"), ["x", "y"]).select(*keys, "often", "pos", "run", "ids"), f"runs-{size}")
    return found


def most_frequent(found: DataFrame, words: list[str], first_id: int, most: int = MOST) -> dict[int, list[str]]:
    """The ``most`` most frequent runs of each size as words between blanks; ties go to the lower ids."""
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.desc("n"), "ids"))
    kept: dict[int, list[str]] = {}
    # at most ``most`` rows of each size
    for row in found.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("size", "rank").collect():
        kept.setdefault(row["size"], []).append(" ".join(words[i - first_id] for i in row["ids"]))
    return kept
