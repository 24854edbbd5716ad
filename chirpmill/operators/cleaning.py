"""Cleaning as a DataFrame step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLEANERS


def with_cleaned(df: DataFrame, cleaner: str, text: str = "text", name: str = "cleaned_text") -> DataFrame:
    """Add the cleaned text, worked out once per row whatever is built on it.

    Used in a filter or inside a condition, a plain column would be put in there as an expression and the
    whole chain of patterns would run again for each use. A one-item ``explode`` keeps it a value.
    """
    cleaned = df.withColumn(f"{name}_once", CLEANERS[cleaner](F.col(text)))
    return cleaned.select(*df.columns, F.explode(F.array(f"{name}_once")).alias(name))


def drop_empty(df: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Drop rows whose text is empty; a missing one goes as well."""
    return df.where(F.length(text) > 0)
