"""The values at given ranks of numeric columns, exactly, by counting passes alone.

A rank starts with all values of its column as its bracket. A pass asks approximate percentiles, whose rank error has a proven
bound, for a thin bracket around the rank, and another counts exactly what lies below and in it. As percentiles of what is
left are as exact as those of the whole, a bracket shrinks about a thousandfold with every pass, whatever the values are and
however often they repeat. What holds ``FEW`` values or fewer is fetched as counts by value. Nothing is sorted or shuffled but
partial sums; a few numbers for each rank go through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
SLACK = 4.0 / ACCURACY
FEW = 20_000


@dataclass
class _Bracket:
    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int


def _within(b: _Bracket) -> Column:
    v = F.col(b.column)
    return (v >= F.lit(b.low)) & (v <= F.lit(b.high))


def _narrowed(df: DataFrame, open_: list[_Bracket]) -> None:
    """One step for all brackets: percentiles inside them, then exact counts."""
    def marks(b: _Bracket) -> list[float]:
        q = (b.rank - b.below) / max(b.inside - 1, 1)
        return [max(0.0, q - SLACK), min(1.0, q + SLACK)]

    said = df.agg(*[
        F.percentile_approx(F.when(_within(b), F.col(b.column)), marks(b), ACCURACY).alias(f"b{i}") for i, b in enumerate(open_)]).first()
    asked = []
    for i, b in enumerate(open_):
        v, (low, high) = F.col(b.column), said[i]
        inner = (v > F.lit(low)) & (v < F.lit(high))
        asked.append(F.struct(
            F.count_if(v < F.lit(low)).alias("below"), F.count_if((v >= F.lit(low)) & (v <= F.lit(high))).alias("inside"),
            F.max(F.when(_within(b) & (v < F.lit(low)), v)).alias("before"),
            F.min(F.when(_within(b) & (v > F.lit(high)), v)).alias("after"),
            F.count_if(v == F.lit(low)).alias("at_low"), F.count_if(v == F.lit(high)).alias("at_high"),
            F.min(F.when(inner, v)).alias("first"), F.max(F.when(inner, v)).alias("last")).alias(f"b{i}"))
    for b, (low, high), c in zip(open_, said, df.agg(*asked).first()):
        end = c["below"] + c["inside"]
        if b.rank < c["below"]:  # beside the bracket, which the bound on the error leaves to rounding
            b.high, b.inside = c["before"], c["below"] - b.below
        elif b.rank >= end:
            b.low, b.below, b.inside = c["after"], end, b.inside - (end - b.below)
        elif b.rank < c["below"] + c["at_low"]:
            b.low = b.high = low
        elif b.rank >= end - c["at_high"]:
            b.low = b.high = high
        else:  # strictly between, so that every step leaves values out
            b.low, b.high, b.below = c["first"], c["last"], c["below"] + c["at_low"]
            b.inside = c["inside"] - c["at_low"] - c["at_high"]


def values_at(df: DataFrame, wanted: dict[str, tuple[int, float, float, list[int]]]) -> dict[tuple[str, int], float]:
    """``(column, rank)`` to value, ranks from 0.

    ``wanted`` has for each column of doubles how many values it holds, the least, the largest and the ranks asked for;
    missing values take no part and there must be no NaN.
    """
    brackets = [_Bracket(c, r, low, high, 0, n) for c, (n, low, high, ranks) in wanted.items() for r in sorted(set(ranks))]
    while True:
        open_ = [b for b in brackets if b.low != b.high and b.inside > FEW]
        if not open_:
            break
        _narrowed(df, open_)
    found = {(b.column, b.rank): b.low for b in brackets if b.low == b.high}
    few: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        if b.low != b.high:
            few.setdefault((b.column, b.low, b.high), []).append(b)
    if few:
        rows = [F.when(_within(own[0]), F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, ((c, _, _), own) in enumerate(few.items())]
        counts = df.select(F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).groupBy("r.i", "r.v").count()
        held: dict[int, list] = {}
        for i, v, n in sorted(tuple(r) for r in counts.collect()):  # FEW rows for each bracket at most
            held.setdefault(i, []).append((v, n))
        for i, own in enumerate(few.values()):
            for b in own:
                upto = b.below
                for v, n in held[i]:
                    upto += n
                    if b.rank < upto:
                        found[b.column, b.rank] = v
                        break
    return found
