"""Exact resampling, balancing, shuffling and stratified splitting, all decided by hashes.

Which rows are taken depends only on the seed and the keys, so a lost executor or another
partitioning gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import RESAMPLE_RATIOS, SEED, TEST_SHARE, VAL_SHARE
from .labels import few_class_sizes
from .ranking import cut_points, hashed_order, with_rank

DRAWS_PER_BLOCK = 1 << 16


def draw_counts(df: DataFrame, ratios: dict[int, float], label: str = "label_id", base: int = 0) -> DataFrame:
    """Draws per class: the truncated share of the base class; one row per class."""
    sizes = few_class_sizes(df, label)
    base_n = F.max(F.when(F.col(label) == base, F.col("n"))).over(Window.partitionBy())
    base_n = F.coalesce(base_n, F.raise_error(F.lit(f"no row of the base class {base}")).cast("long"))
    share = F.create_map(*[F.lit(x) for k, r in sorted(ratios.items()) for x in (k, float(r))])
    return (
        sizes.withColumn("draws", F.floor(base_n.cast("double") * F.try_element_at(share, F.col(label))).cast("long"))
        .where("draws > 0").select(label, F.col("n").alias("class_n"), "draws")
    )


def _draws(counts: DataFrame, label: str, seed: int) -> DataFrame:
    """One row per draw: ``(label, draw_no, place)`` with ``place`` uniform in the class.

    Draws are spread in blocks over the shuffle partitions before they are written out one by one.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_block = F.floor((F.col("draws") - 1) / DRAWS_PER_BLOCK).cast("long")
    blocks = (
        counts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("block"))
        .repartition(parts, label, "block")
    )
    first = F.col("block") * DRAWS_PER_BLOCK + 1
    numbered = blocks.select(
        label, "class_n", F.explode(F.sequence(first, F.least(first + (DRAWS_PER_BLOCK - 1), F.col("draws")))).alias("draw_no")
    )
    number = F.conv(F.substring(hashed_order(seed, label, "draw_no"), 1, 15), 16, 10).cast("long")
    return numbered.select(label, "draw_no", (number % F.col("class_n")).alias("place"))


def resample(df: DataFrame, ratios: dict[int, float] | None = None, key: str = "post_id",
             label: str = "label_id", base: int = 0, seed: int = SEED) -> DataFrame:
    """Exactly n uniform draws with replacement from each class in ``ratios``: ``(key, label, draw_no)``.

    A draw names a place in its class; places are ranks by hash. Only keys take part. The join on
    (class, place) is even for any class sizes.
    """
    ratios = ratios or RESAMPLE_RATIOS
    keys = df.select(key, label)
    counts = draw_counts(keys, ratios, label, base)
    ranked = with_rank(
        keys.where(F.col(label).isin(*ratios)).withColumn("order_key", hashed_order(seed, key)),
        "order_key", [label], "place",
    )
    # the planner takes the draws for as few as the classes they are written out from: keep it from broadcasting
    return _draws(counts, label, seed).hint("merge").join(ranked, [label, "place"]).select(key, label, "draw_no")


def balance(df: DataFrame, ratios: dict[int, float] | None = None, key: str = "post_id",
            label: str = "label_id", base: int = 0, seed: int = SEED) -> DataFrame:
    """The base class and classes without a ratio as they are (``draw_no`` 0) and the draws of the others.

    ``(key, draw_no)`` is unique. Without a row of the base class there is nothing to measure by, which is an error.
    """
    ratios = ratios or RESAMPLE_RATIOS
    kept = df.where(~F.coalesce(F.col(label).isin(*ratios), F.lit(False))).select(key, label, F.lit(0).cast("long").alias("draw_no"))
    return kept.unionByName(resample(df, ratios, key, label, base, seed))


def shuffle_rank(df: DataFrame, keys: list[str], seed: int = SEED) -> DataFrame:
    """A dense random order from 1, as a column: row order is no property of a table."""
    ordered = df.withColumn("order_key", hashed_order(seed, *keys))
    return with_rank(ordered, "order_key", None, "rank0").withColumn("shuffle_rank", F.col("rank0") + 1).drop("order_key", "rank0")


def _largest_remainder(sizes: DataFrame, label: str, n: str, total: str, wanted: Column, name: str) -> DataFrame:
    """Share out ``wanted`` rows in proportion to ``n``; equal remainders go to the lower class."""
    exact = F.col(n) / F.col(total) * wanted
    floored = F.floor(exact)
    every = Window.partitionBy()
    by_remainder = Window.orderBy(F.desc("remainder"), label)
    return (
        sizes.withColumn("floored", floored).withColumn("remainder", exact - floored).withColumn("wanted", wanted)
        .withColumn("missing", F.col("wanted") - F.sum("floored").over(every))
        .withColumn(name, (F.col("floored") + F.when(F.row_number().over(by_remainder) <= F.col("missing"), 1).otherwise(0)).cast("long"))
        .drop("floored", "remainder", "wanted", "missing")
    )


def split_quotas(sizes: DataFrame, label: str = "label_id", test_share: float = TEST_SHARE,
                 val_share: float = 0.0) -> DataFrame:
    """Rows of each class that go to train, validation and test; one row per class throughout."""
    every = Window.partitionBy()
    total = sizes.withColumn("total", F.sum("n").over(every).cast("double"))
    rest = F.col("total") - F.ceil(F.lit(test_share) * F.col("total"))
    first = _largest_remainder(total, label, "n", "total", rest, "rest_n")
    again = first.withColumn("rest_total", F.sum("rest_n").over(every).cast("double"))
    train = F.col("rest_total") - F.ceil(F.lit(val_share) * F.col("rest_total"))
    quotas = _largest_remainder(again, label, "rest_n", "rest_total", train, "train_n")
    return quotas.select(label, "n", "train_n", (F.col("rest_n") - F.col("train_n")).alias("val_n"),
                         (F.col("n") - F.col("rest_n")).alias("test_n"))


def stratified_split(df: DataFrame, keys: list[str], label: str = "label_id", test_share: float = TEST_SHARE,
                     val_share: float = 0.0, seed: int = SEED) -> DataFrame:
    """Add ``split``: exact per-class quotas, rows taken in hashed order (train, then val, then test).

    The rows themselves are never shuffled. Per class, the order values at the quota ranks are found
    from bucket counts and one ranked bucket each; assigning a row then compares it with those values.
    Splitting the remainder again with the same order is the same as one cut at two ranks.
    """
    ordered = df.withColumn("order_key", hashed_order(seed, *keys))
    narrow = ordered.select(label, "order_key")
    quotas = split_quotas(few_class_sizes(df.select(label), label), label, test_share, val_share)
    cuts = quotas.select(label, F.inline(F.array(
        F.struct(F.lit("train").alias("cut"), F.col("train_n").alias("cut_rank")),
        F.struct(F.lit("val").alias("cut"), (F.col("train_n") + F.col("val_n")).alias("cut_rank")),
    )))
    points = cut_points(narrow, "order_key", label, cuts).groupBy(label).agg(
        F.max(F.when(F.col("cut") == "train", F.col("cut_value"))).alias("train_to"),
        F.max(F.when(F.col("cut") == "val", F.col("cut_value"))).alias("val_to"),
    )
    # one row per class; a class without a cut value has no row in that split
    cut = ordered.join(F.broadcast(points), label, "left")
    split = (
        F.when(F.col("order_key") <= F.coalesce("train_to", F.lit("")), "train")
        .when(F.col("order_key") <= F.coalesce("val_to", F.lit("")), "val")
        .otherwise("test")
    )
    return cut.withColumn("split", split).drop("order_key", "train_to", "val_to")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
