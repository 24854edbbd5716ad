"""Sentiment analytics over short public posts, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
