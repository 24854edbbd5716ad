"""Label ids, class sizes and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checked_small


# a label column with more values than this is no label column
MAX_CLASSES = 1000


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """The label table: distinct values present, ids from 0 in alphabetical order.

    Ranked after the distinct, so over as many rows as there are classes.
    """
    found = checked_small(df.where(F.col(column).isNotNull()).select(column).distinct(), MAX_CLASSES, "classes")
    return found.withColumn("label_id", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def encode_labels(df: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Attach the id of each label, NULL for a missing one."""
    return df.join(F.broadcast(labels), column, "left")


def class_sizes(df: DataFrame, label: str = "label_id") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def few_class_sizes(df: DataFrame, label: str = "label_id") -> DataFrame:
    """Class sizes as a local table that is known to be small."""
    return checked_small(class_sizes(df, label), MAX_CLASSES, "classes")


def class_weights(df: DataFrame, label: str = "label_id") -> DataFrame:
    """Balanced weights: rows / (classes x rows of the class)."""
    every = Window.partitionBy()
    return few_class_sizes(df, label).select(
        label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight")
    )


def attach_class_weight(df: DataFrame, weights: DataFrame, label: str = "label_id") -> DataFrame:
    """Put the weight of its class on each row, 0 for a class without one."""
    joined = df.join(F.broadcast(weights.select(label, "weight")), label, "left")
    return joined.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
