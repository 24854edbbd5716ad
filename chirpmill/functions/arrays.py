"""Probability rows and integer sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(probs: Column) -> Column:
    """0-based place of the largest value; the first one wins."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def softmax(scores: list[Column]) -> list[Column]:
    """Shares of ``exp(score - largest)``, one column per class."""
    top = F.greatest(*scores)
    powers = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, powers)
    return [x / total for x in powers]


def pad_left(seq: Column, length: int, value: int = 0) -> Column:
    """Keep the last ``length`` items, fill up on the left."""
    size = F.size(seq)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - size))
    return F.concat(fill, F.slice(seq, F.greatest(F.lit(0), size - length) + 1, F.lit(length)))


def pad_right(seq: Column, length: int, value: int = 0) -> Column:
    """Keep the first ``length`` items, fill up on the right."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(seq)))
    return F.concat(F.slice(seq, 1, length), fill)


def attention_mask(seq: Column, length: int) -> Column:
    """1 for each kept item, 0 for each filled place."""
    kept = F.least(F.size(seq), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))
