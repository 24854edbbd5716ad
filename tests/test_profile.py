"""Profile operators against pandas and NumPy, and sections by schema."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from chirpmill.operators import profile
from chirpmill.plans import profiling
from chirpmill.sources.posts import posts


def _frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, x {kind}").repartition(5)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], list(np.random.default_rng(1).normal(size=3001)), [5.0] * 400 + [1.0, 9.0],
    [0.0] * 1000 + list(range(500)), [float(2 ** 60), -1.0, 0.5, None], list(np.random.default_rng(2).exponential(size=20011)),
])
def test_quartiles_are_exact(spark, values):
    row = profile.describe(_frame(spark, [None if v is None else float(v) for v in values]), "id").where("column_name = 'x'").first()
    expected = pd.Series(values, dtype="float64").describe()
    assert row["count"] == expected["count"]
    for name, key in (("mean", "mean"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert row[name] == pytest.approx(expected[key], abs=2e-6, rel=1e-12)


def test_describe_takes_the_first_seen_value_among_equal_counts(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (5, "a"), (4, "c"), (6, None)], "id bigint, s string")
    row = profile.describe(df, "id").where("column_name = 's'").first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (5, 3, "a", 2)


def test_describe_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id bigint, s string")
    row = profile.describe(df, "id").where("column_name = 's'").first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (0, 0, None, None)


@pytest.mark.parametrize("values,bins", [([1, 2, 3, 10, 10, 7], 5), ([4], 50), ([4, 4, 4], 3), (list(range(1000)), 30)])
def test_histogram_follows_numpy(spark, values, bins):
    rows = profile.histogram(_frame(spark, values, "int"), F.col("x"), bins).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["n"] for r in rows] == list(counts)
    assert [r["bin_start"] for r in rows] == pytest.approx(list(edges[:-1]), abs=1e-6)


def test_missing_counts_nan_on_float_columns(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0), (4, 2.0)], "id bigint, x double")
    assert [tuple(r) for r in profile.missing(df).collect()] == [("x", 2, 50.0)]


def test_crosstab_follows_pandas(spark, folder):
    df = posts(spark, folder)
    pdf = df.select("brand", "sentiment").toPandas()
    expected = pd.crosstab(pdf["brand"], pdf["sentiment"])
    rows = profile.crosstab(df, "brand", "sentiment", ("negative", "neutral", "positive")).collect()
    assert {r["brand"]: (r["negative"], r["neutral"], r["positive"]) for r in rows} == {
        b: tuple(int(v) for v in row) for b, row in zip(expected.index, expected.to_numpy())}


def test_sections_follow_the_columns(spark, folder, tmp_path):
    full = posts(spark, folder)
    assert "brand_sentiment" in profiling.sections(full)
    bare = profiling.sections(full.select("post_id", "lang"))
    assert set(bare) == {"basic", "schema", "preview", "describe", "missing"}
    names = profiling.write_sections(full, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/brand_counts").count() == 20
    assert len(names) == 13


def test_histogram_reads_the_text_once(spark, folder):
    plan = profiling.sections(posts(spark, folder))["text_length_hist"]()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1


def test_describe_counts_nan_as_missing(spark):
    import datetime

    nan, day = float("nan"), datetime.date(1970, 1, 3)
    df = spark.createDataFrame(
        [("k1", nan, True, day, "x"), ("k2", 1.0, False, None, "y"), ("k3", 3.0, True, day, "y"), ("k4", None, None, None, "x")],
        "key string, v double, flag boolean, day date, s string")
    rows = {r["column_name"]: r for r in profile.describe(df, "key").collect()}
    v = rows["v"]
    assert (v["count"], v["mean"], v["std"], v["p25"], v["p75"], v["max"]) == (2, 2.0, 1.414214, 1.5, 2.5, 3.0)
    assert (rows["flag"]["count"], rows["flag"]["unique"], rows["flag"]["top"], rows["flag"]["freq"]) == (3, 2, "true", 2)
    assert (rows["s"]["top"], rows["s"]["freq"]) == ("x", 2)
    assert (rows["day"]["count"], rows["day"]["mean"], rows["day"]["std"]) == (2, 172800.0, None)
    assert profile.describe(df.select(F.array("key").alias("a")), "a").collect() == []


def test_histogram_of_nothing_has_its_bins(spark):
    rows = profile.histogram(spark.createDataFrame([], "v int"), F.col("v"), 4).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(i, 0) for i in range(4)]


def test_sections_start_no_job(spark, folder):
    tracker = spark.sparkContext.statusTracker()
    full = posts(spark, folder)
    spark.sparkContext.setJobGroup("sections", "sections")
    profiling.sections(full)
    assert not tracker.getJobIdsForGroup("sections")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _crosses(plan: str) -> list[str]:
    """What the exchanges of a plan move."""
    return [line for line in plan.splitlines() if "Exchange hash" in line]


def test_reports_move_no_text(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("profile_basic", "profile_missing"):
            df = contract.queries()[name](spark, folder)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert _crosses(plan)
            # the scan is the only place that names the text itself
            text = next(line for line in plan.splitlines() if "documents.parquet" in line).split("[")[1].split("]")[0]
            column = next(c for c in text.split(",") if c.startswith("text#"))
            above = plan[:plan.index("FileScan")]
            moved = [line for line in above.splitlines() if "Exchange" in line]
            assert not any(column in line for line in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
