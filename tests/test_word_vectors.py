"""Word vectors follow from the rows and the seed alone."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array

from chirpmill.operators import members, word_vectors


def texts(rng, n):
    groups = [["sad", "grey", "rain", "cold"], ["glad", "bright", "sun", "warm"]]
    return [" ".join(rng.choice(rng.choice(groups) if rng.random() < .1 else groups[i % 2]) for _ in range(rng.randint(0, 12))) for i in range(n)]


def table(spark, said):
    return members.with_tokens(spark.createDataFrame([(i, 0, t) for i, t in enumerate(said)], "post_id long, draw_no int, cleaned_text string"))


def test_counts_by_brute_force(spark):
    rng = random.Random(2)
    rows = [([rng.randint(0, 6) for _ in range(rng.randint(0, 15))], rng.randint(1, 3)) for _ in range(40)] + [([], 2), (None, 1)]
    said = Counter()
    for ids, often in rows:
        for i, x in enumerate(ids or []):
            for d, y in enumerate(ids[i + 1:i + 6], 1):
                said[min(x, y), max(x, y)] += 60 // d * often
    df = spark.createDataFrame(rows, "sequence array<int>, times int")
    assert {(r.a, r.b): r.n for r in word_vectors.cooccurrence(df, times="times").collect()} == said
    with pytest.raises(ValueError):
        word_vectors.cooccurrence(df, window=7)


def test_pairs_are_added_up_before_the_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([([1, None, 2, None, None, 3],), (None,), ([],), ([5],), ([2, 2, 2],), ([7, 2**31 - 1],)] * 50, "sequence array<int>")
    one = word_vectors.cooccurrence(rows.coalesce(1))
    said = {(r.a, r.b): r.n for r in one.collect()}
    assert said[2, 2] == 50 * 300 and said[7, 2**31 - 1] == 50 * 60 and (2, 5) not in said
    # a missing id stands for the other one, two missing for none
    assert said[1, 2] == 50 * 30 and said[1, 1] == 50 * 95 and said[None, None] == 50 * 110 and len(said) == 8
    assert "MapInArrow" in one._jdf.queryExecution().executedPlan().toString() and "Generate" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(word_vectors, "PLACES", 3)
    assert {(r.a, r.b): r.n for r in word_vectors.cooccurrence(rows.coalesce(1)).collect()} == said


def test_information_of_both_orders(spark):
    counts = {(0, 0): 3, (0, 1): 10, (1, 2): 4, (0, 2): 1}
    both = Counter()
    for (a, b), n in counts.items():
        both[a, b] += n
        both[b, a] += n
    row = Counter()
    for (a, _), n in both.items():
        row[a] += n
    whole = sum(row.values())
    expected = {k: math.log(n * whole / (row[k[0]] * row[k[1]])) for k, n in both.items()}
    df = spark.createDataFrame([(*k, n) for k, n in counts.items()], "a int, b int, n long")
    got = {(r.a, b): v for r in word_vectors.information(df).collect() for b, v in zip(r.places, r["values"])}
    assert got == pytest.approx({k: v for k, v in expected.items() if v > 0})


def test_directions_are_those_of_the_matrix(spark):
    rng = np.random.RandomState(3)
    dense = np.abs(rng.standard_normal((12, 12))) * (rng.random((12, 12)) < .5)
    dense = dense + dense.T
    dense[5] = dense[:, 5] = 0
    rows = spark.createDataFrame(
        [(i, [int(j) for j in np.flatnonzero(dense[i])], [float(v) for v in dense[i][dense[i] != 0]]) for i in range(12) if dense[i].any()],
        "a int, places array<int>, values array<double>")
    found = word_vectors.leading(rows, 12, 3, rounds=200)
    sizes, directions = np.linalg.eigh(dense)
    for k, at in enumerate(np.argsort(-np.abs(sizes))[:3]):
        assert np.allclose(np.abs(found[:, k]), np.abs(directions[:, at]) * np.sqrt(abs(sizes[at])), atol=1e-6)
    assert not found[5].any()
    assert word_vectors.leading(rows, 12, 15).shape == (12, 15)
    with pytest.raises(ValueError, match="more than"):
        word_vectors.fitted(rows, 12, limit=11)


def test_equal_for_any_partitioning(spark):
    said = texts(random.Random(4), 150)
    found = []
    for n in (1, 7):
        rows = table(spark, said).repartition(n)
        model = members.fit_word_vectors(rows, members.fitted_words(rows), size=6).stages[-1]
        found.append({r["word"]: tuple(r["v"]) for r in model.getVectors().select("word", vector_to_array("vector").alias("v")).collect()})
    assert found[0] == found[1] and len(found[0]) == 9


def test_words_of_like_company_are_near(spark):
    rows = table(spark, texts(random.Random(5), 300))
    model = members.fit_word_vectors(rows, members.fitted_words(rows), size=4).stages[-1]
    v = {r["word"]: np.array(r["v"]) for r in model.getVectors().select("word", vector_to_array("vector").alias("v")).collect()}
    near = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert min(near("sad", "rain"), near("sun", "warm")) > max(near("sad", "sun"), near("rain", "glad"))


def test_rows_without_words(spark):
    rows = table(spark, ["", ""])
    model = members.fit_word_vectors(rows, [], size=3)
    assert [list(r["vector"]) for r in model.transform(rows).collect()] == [[0.0] * 3] * 2
