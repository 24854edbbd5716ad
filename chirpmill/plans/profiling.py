"""The profile of a posts table: every section whose columns are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import CLASSES, LENGTH_BINS, WORD_BINS
from ..functions.text import text_length, word_count
from ..operators import profile as p
from ..sources.files import write_report


def sections(df: DataFrame, key: str = "post_id") -> dict[str, Callable[[], DataFrame]]:
    """Report name to a function that makes it; nothing runs until one is called."""
    found: dict[str, Callable[[], DataFrame]] = {
        "basic": lambda: p.basic(df), "schema": lambda: p.schema_report(df), "preview": lambda: p.preview(df, key),
        "describe": lambda: p.describe(df, key), "missing": lambda: p.missing(df),
    }
    if p.has_columns(df, "sentiment"):
        found["sentiment_counts"] = lambda: p.frequencies(df, "sentiment")
        found["sentiment_share"] = lambda: p.shares(df, "sentiment")
    if p.has_columns(df, "text"):
        found["text_length_stats"] = lambda: p.text_length_stats(df)
        found["text_length_hist"] = lambda: p.histogram(df, text_length(F.col("text")), LENGTH_BINS)
        found["word_count_hist"] = lambda: p.histogram(df, word_count(F.col("text")), WORD_BINS)
    if p.has_columns(df, "sentiment", "text"):
        found["samples"] = lambda: p.samples_per_class(df, "sentiment", "text", key)
    if p.has_columns(df, "brand"):
        found["brand_counts"] = lambda: p.frequencies(df, "brand")
    if p.has_columns(df, "brand", "sentiment"):
        found["brand_sentiment"] = lambda: p.crosstab(df, "brand", "sentiment", CLASSES)
    return found


def write_sections(df: DataFrame, folder: str, key: str = "post_id") -> list[str]:
    """Save every report as Parquet below ``folder``; returns the names."""
    found = sections(df, key)
    for name, report in found.items():
        write_report(report(), f"{folder}/{name}")
    return list(found)
