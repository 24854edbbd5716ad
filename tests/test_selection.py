"""Exact values at ranks, and ranks with deeper buckets."""

import random

import pytest
from pyspark.sql import functions as F

from chirpmill.operators import profile, ranking, selection


def frame(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")


CASES = {
    "many": [random.Random(1).gauss(0, 1e6) for _ in range(4000)],
    "steep": [10.0 ** random.Random(i).uniform(-300, 300) * (-1) ** i for i in range(3000)],
    "few values": [random.Random(i).choice([1, 2, 2, 2, 9]) for i in range(3000)] + [None] * 50,
    "one value": [7] * 500,
    "one row": [3],
    "hot": [5.0] * 2000 + [i / 7 for i in range(900)],
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("few", [3, 300])
def test_values_at_ranks(spark, monkeypatch, name, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "ACCURACY", 50)
    monkeypatch.setattr(selection, "SLACK", 4 / 50)
    values = sorted(float(v) for v in CASES[name] if v is not None)
    n = len(values)
    ranks = sorted({0, n - 1, n // 2, n // 4, max(0, n - 2), 3 * n // 4})
    df = frame(spark, random.Random(2).sample(CASES[name], len(CASES[name]))).repartition(5)
    found = selection.values_at(df, {"x": (n, values[0], values[-1], ranks)})
    assert found == {("x", r): values[r] for r in ranks}


def test_no_window_and_no_sort_over_values(spark, monkeypatch):
    df = spark.range(0, 3_000_000, 1, 8).select(((F.col("id") * 7919) % 3_000_017).cast("double").alias("x"))
    row = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    steps = []
    real = selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda d, o: (steps.append(max(b.inside for b in o)), real(d, o)))
    found = selection.values_at(df, {"x": (*row, [1_500_000])})
    assert df.where(F.col("x") < found["x", 1_500_000]).count() == 1_500_000
    assert len(steps) == 1  # one narrowing step takes three million values below FEW


def test_quartiles_of_several_columns(spark):
    df = spark.range(1001).select("id", (F.col("id") / 4).alias("a"), F.lit(None).cast("int").alias("none"), F.lit(2).alias("two"))
    rows = {r.column_name: (r["count"], r.p25, r.p50, r.p75) for r in profile.describe(df, "id").collect()}
    assert rows["a"] == (1001, 62.5, 125.0, 187.5) and rows["two"] == (1001, 2.0, 2.0, 2.0) and rows["none"] == (0, None, None, None)


@pytest.mark.parametrize("bound, expected", [(1 << 20, 1), (10, 2), (1, 3)])
def test_ranks_with_buckets_as_deep_as_a_bound_asks(spark, monkeypatch, bound, expected):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bound)
    monkeypatch.setattr(ranking, "DIGITS", 1)
    df = spark.range(600).select("id", F.when(F.col("id") < 500, "a").otherwise("b").alias("g")).withColumn("h", ranking.hashed_order(3, "id"))
    assert ranking.levels(df, ["g"]) == expected
    rows = df.collect()
    place = {r.id: i for g in "ab" for i, r in enumerate(sorted((r for r in rows if r.g == g), key=lambda r: r.h))}
    assert {r.id: r["rank"] for r in ranking.with_rank(df, "h", ["g"]).collect()} == place
    cuts = spark.createDataFrame([("a", "x", 1), ("a", "y", 377), ("b", "x", 100)], "g string, cut string, cut_rank long")
    got = {(r.g, r.cut): r.cut_value for r in ranking.cut_points(df, "h", "g", cuts).collect()}
    at = {(r.g, place[r.id] + 1): r.h for r in rows}
    assert got == {(g, c): at[g, n] for g, c, n in cuts.collect()}
    alone = ranking.with_rank(df, "h").collect()
    assert [r.id for r in sorted(alone, key=lambda r: r["rank"])] == [r.id for r in sorted(rows, key=lambda r: r.h)]
