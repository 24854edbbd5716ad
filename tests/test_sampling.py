"""Sizes, quotas, determinism, and hot classes."""

import math

import pytest
from pyspark.sql import functions as F

from chirpmill.operators import labels, ranking, sampling
from chirpmill.plans import training


def _classes(spark, sizes, partitions=4):
    rows = [(1000 * k + i, k) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "post_id bigint, label_id int").repartition(partitions)


def _all(df):
    return sorted(tuple(r) for r in df.collect())


def test_rank_is_dense_and_exact_for_a_hot_group(spark):
    df = _classes(spark, [900, 3, 40]).withColumn("order_key", ranking.hashed_order(7, "post_id"))
    rows = ranking.with_rank(df, "order_key", ["label_id"]).collect()
    for k in range(3):
        mine = sorted((r for r in rows if r["label_id"] == k), key=lambda r: r["order_key"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("sizes", [[90, 10, 200], [7, 1, 1], [3000, 5000, 1]])
def test_resample_has_the_exact_size(spark, sizes):
    got = sampling.resample(_classes(spark, sizes)).groupBy("label_id").count().collect()
    wanted = {k: int(sizes[0] * r) for k, r in ((1, 0.7), (2, 0.6)) if int(sizes[0] * r)}
    assert {r[0]: r[1] for r in got} == wanted


def test_draws_over_many_blocks_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DRAWS_PER_BLOCK", 16)
    got = sampling.resample(_classes(spark, [500, 20, 20])).where("label_id = 1").select("draw_no").collect()
    assert sorted(r[0] for r in got) == list(range(1, 351))


def test_draws_are_spread_over_the_class(spark):
    got = sampling.resample(_classes(spark, [1000, 10, 1])).where("label_id = 1").groupBy("post_id").count().collect()
    assert len(got) == 10 and all(40 <= r[1] <= 105 for r in got)


def test_balanced_keys_are_unique_and_keep_the_base_class(spark):
    df = sampling.balance(_classes(spark, [50, 30, 80]))
    assert df.count() == df.select("post_id", "draw_no").distinct().count() == 50 + 35 + 30
    assert df.where("label_id = 0").count() == 50


@pytest.mark.parametrize("sizes", [[50, 30, 80], [10, 10, 10], [1, 1, 5], [401, 3, 17]])
def test_split_quotas(spark, sizes):
    n = sum(sizes)
    test = math.ceil(0.15 * n)
    rest = n - test
    val = math.ceil(0.10 * rest)
    rows = sampling.stratified_split(_classes(spark, sizes), ["post_id"], val_share=0.10).collect()
    count = lambda s: sum(r["split"] == s for r in rows)
    assert (count("test"), count("val"), count("train")) == (test, val, rest - val)
    for k, size in enumerate(sizes):
        own = sum(r["split"] == "test" and r["label_id"] == k for r in rows)
        assert abs(own - size * test / n) < 1
    assert len({r["post_id"] for r in rows}) == n


def test_equal_remainders_go_to_the_lower_class(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "label_id int, n bigint")
    rows = sampling.split_quotas(sizes, test_share=0.15).orderBy("label_id").collect()
    # 25 rows stay, 8 1/3 each: the odd one goes to class 0
    assert [r["n"] - r["test_n"] for r in rows] == [9, 8, 8]


def test_same_result_for_any_partitioning(spark):
    found = set()
    for parts in (1, 4, 17):
        df = _classes(spark, [60, 45, 90], parts)
        keys = training.training_keys(df)
        found.add((tuple(_all(keys.select("post_id", "draw_no", "label_id", "split"))),
                   tuple(_all(sampling.shuffle_rank(df, ["post_id"]).select("post_id", "shuffle_rank")))))
    assert len(found) == 1


def test_shuffle_rank_is_a_permutation(spark):
    rows = sampling.shuffle_rank(_classes(spark, [70, 3, 9]), ["post_id"]).collect()
    assert sorted(r["shuffle_rank"] for r in rows) == list(range(1, 83))


def test_another_seed_takes_other_rows(spark):
    df = _classes(spark, [100, 80, 90])
    assert _all(sampling.resample(df, seed=1)) != _all(sampling.resample(df, seed=2))


def test_balancing_after_the_split_keeps_sides_apart(spark):
    keys = training.training_keys(_classes(spark, [60, 45, 90]), balance_after_split=True)
    sides = keys.groupBy("post_id").agg(F.count_distinct("split").alias("sides"))
    assert sides.where("sides > 1").count() == 0


def test_class_weights_average_to_one(spark):
    df = _classes(spark, [60, 30, 10])
    weights = {r["label_id"]: r["weight"] for r in labels.class_weights(df).collect()}
    assert weights == pytest.approx({0: 100 / 180, 1: 100 / 90, 2: 100 / 30})
    assert labels.attach_class_weight(df, labels.class_weights(df)).agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_label_ids_are_alphabetical(spark):
    df = spark.createDataFrame([("positive",), ("negative",), ("neutral",), (None,)], "s string")
    rows = labels.encode_labels(df, labels.fit_labels(df, "s"), "s").collect()
    assert {r["s"]: r["label_id"] for r in rows} == {"negative": 0, "neutral": 1, "positive": 2, None: None}


def test_draws_are_never_broadcast(spark):
    plan = sampling.resample(_classes(spark, [50, 30, 80]))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_too_many_classes_is_an_error_not_a_cut(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_CLASSES", 2)
    with pytest.raises(ValueError):
        labels.class_weights(_classes(spark, [5, 3, 8]))


def test_a_class_without_a_ratio_stays_and_the_base_must_be_there(spark):
    df = sampling.balance(_classes(spark, [20, 20, 20, 20]))
    n = {r["label_id"]: r["count"] for r in df.groupBy("label_id").count().collect()}
    assert n == {0: 20, 1: 14, 2: 12, 3: 20}
    with pytest.raises(Exception, match="base class"):
        sampling.balance(_classes(spark, [0, 20, 20])).collect()


def test_a_null_key_is_an_error(spark):
    rows = spark.createDataFrame([(None, 0), (1, 0)], "post_id bigint, label_id int")
    with pytest.raises(Exception, match="post_id is NULL"):
        sampling.shuffle_rank(rows, ["post_id"]).collect()
