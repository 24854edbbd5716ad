import math

import numpy as np
from pyspark.sql import functions as F

from chirpmill.llm import neighbours
from chirpmill.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, queries, k=5):
    out = {}
    for q in queries:
        score = neighbours.cosine(x, x[ids == q][0])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    got = {}
    for r in QUERIES["op9_neighbours"](spark, folder).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        near = dict(want[q])
        hits += sum(f[1] in near and math.isclose(near[f[1]], f[2], abs_tol=1e-12) for f in found)
    return hits / sum(map(len, want.values()))


def test_recall(spark):
    assert recall(spark, "/root/testdata/sf0.1") >= 0.9


def test_early_end_loses_little():
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(4000, 64)))
    hits = 0
    for q in neighbours.unit(rng.normal(size=(50, 64))):
        rows = neighbours.scan_list(x, q, 6)
        hits += len(set(rows) & set(np.argsort(((x - q) ** 2).sum(axis=1))[:6]))
    assert hits >= 0.97 * 300


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]),
            (8, [1.0, 1.0]), (8, [1.0, 1.0]), (50, [3e30, 3e30]), (100, [0.0, 0.0]), (None, [1.0, 0.0]), (9, []), (10, [-1.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit(1)).withColumn("score", F.lit("s")),
                            F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {0: [1, 8, 50, 10], 50: [8, 0, 1, 10]}
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_one_vector_in_most_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(300, 400)]
    got = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and all(abs(r["score"] - 1) < 1e-12 for r in got)


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0, float(i)]) for i in range(1, 9)] + [(50 + i, [1.0, 0.0, float(i)]) for i in range(4)] + [(100, [2.0])]
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {50: [51, 52]}
    few = neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin(1, 50), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(1, 2), (1, 3), (50, 51), (50, 52)]
