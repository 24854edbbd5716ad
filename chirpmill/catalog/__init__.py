"""Named queries over the given tables, each with the SQL that must give the same rows."""

from .registry import QUERIES, SQL

from . import profile_queries, text_queries, sampling_queries, token_queries, score_queries, model_queries  # noqa: E402,F401

__all__ = ["QUERIES", "SQL"]
