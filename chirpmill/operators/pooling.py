"""Pooling of vectors by group, and joining vectors end to end."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    # one buffer for all places, whatever their number; vectors of different lengths in a group are an error
    values = array_to_vector(F.col(vector).cast("array<double>"))
    return df.where(F.col(vector).isNotNull()).groupBy(key).agg(Summarizer.metrics("mean", "max").summary(values).alias("s"))


def mean_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    return _pooled(df, key, vector).select(key, vector_to_array("s.mean").alias(vector))


def max_pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    return _pooled(df, key, vector).select(key, vector_to_array("s.max").alias(vector))


def pool_both(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Both pools in one pass, as ``mean`` and ``max``."""
    return _pooled(df, key, vector).select(key, vector_to_array("s.mean").alias("mean"), vector_to_array("s.max").alias("max"))


def concat_vectors(*vectors: Column) -> Column:
    return F.concat(*vectors)
