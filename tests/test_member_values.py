"""Members against plain models of the same tiny table."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpmill.operators import ensemble, members

WORDS = ["sad", "plain", "glad", "day", "grey"]
TEXTS = ["sad grey day", "sad sad day", "grey day", "plain day", "plain plain day glad", "glad day", "glad glad sad day", "glad other day",
         "plain unseen words", "sad plain"]
LABELS = [0, 0, 0, 1, 1, 2, 2, 2, 1, 0]
WEIGHTS = [1.0, 2.0, 0.5, 1.5, 1.0, 1.0, 2.5, 1.0, 0.75, 1.0]


@pytest.fixture(scope="module")
def train(spark):
    rows = [(i, 0, y, w, t) for i, (t, y, w) in enumerate(zip(TEXTS, LABELS, WEIGHTS))]
    return members.with_tokens(spark.createDataFrame(
        rows, "post_id bigint, draw_no bigint, label_id int, weight double, cleaned_text string"))


def known():
    return [[w if w in WORDS else members.UNKNOWN for w in t.split()] for t in TEXTS]


def probabilities(train, model_id, model):
    rows = members.predict_proba(train, {model_id: model}, ["post_id"]).orderBy("post_id").collect()
    return np.array([[r[ensemble._p(model_id, k)] for k in range(3)] for r in rows])


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counted(terms, lists):
    return np.array([[Counter(words)[t] for t in terms] for words in lists], float)


def test_logistic_is_the_least_weighted_loss(train):
    model = members.fit_members(train, {1: members.logistic_member(WORDS, reg=0.02, max_iter=300)})[1]
    tf = counted([*WORDS, members.UNKNOWN], known())
    x = tf * np.log((len(TEXTS) + 1) / ((tf > 0).sum(axis=0) + 1))
    last = model.stages[-1]
    p = softmax(x @ last.coefficientMatrix.toArray().T + last.interceptVector.toArray())
    assert np.allclose(p, probabilities(train, 1, model), atol=1e-9)
    # at the least loss its slope is zero: what the rows pull is what the penalty on scaled coefficients holds
    w, y = np.array(WEIGHTS), np.eye(3)[LABELS]
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    variance = (w[:, None] * (x - mean) ** 2).sum(axis=0) / (w.sum() - (w ** 2).sum() / w.sum())
    slope = ((w[:, None] * (p - y)).T @ x) / w.sum() + 0.02 * variance * last.coefficientMatrix.toArray()
    assert np.abs(slope).max() < 1e-4
    assert np.abs((w[:, None] * (p - y)).sum(axis=0) / w.sum()).max() < 1e-4


def test_bayes_by_hand(train):
    grams = {2: ["sad grey", "grey day", "plain day", "glad day"], 3: ["sad grey day"]}
    model = members.fit_members(train, {2: members.ngram_bayes_member(WORDS, grams, smoothing=0.5)})[2]
    terms = [*grams[2], *grams[3], *[" ".join([members.UNKNOWN] * n) for n in (4, 5)]]
    runs = [[" ".join(t[i:i + n]) for n in (2, 3, 4, 5) for i in range(len(t) - n + 1)] for t in known()]
    x, w, y = counted(terms, runs), np.array(WEIGHTS), np.eye(3)[LABELS]
    prior = np.log(w @ y + 0.5) - np.log(w.sum() + 3 * 0.5)
    seen = (w[:, None] * y).T @ x
    theta = np.log(seen + 0.5) - np.log(seen.sum(axis=1, keepdims=True) + len(terms) * 0.5)
    assert np.allclose(softmax(x @ theta.T + prior), probabilities(train, 2, model), atol=1e-9)


def vectors_of(train):
    vectors = members.fit_word_vectors(train, WORDS, size=4)
    found = {r["word"]: r["vector"].toArray() for r in vectors.stages[-1].getVectors().collect()}
    return vectors, np.array([np.mean([found[w] for w in words], axis=0) for words in known()])


def test_forest_is_the_mean_of_its_trees(train):
    vectors, x = vectors_of(train)
    model = members.fit_members(train, {3: members.forest_member(vectors, trees=5, depth=3)})[3]
    ready = model.stages[0].transform(train)
    rows = model.stages[1].transform(ready).orderBy("post_id").collect()
    assert np.allclose([r["vector_3"].toArray() for r in rows], x, atol=1e-6)
    trees = model.stages[-1].trees
    each = [np.array([tree.predictRaw(r["vector_3"]).toArray() for r in rows]) for tree in trees]
    p = np.mean([t / t.sum(axis=1, keepdims=True) for t in each], axis=0)
    assert len(trees) == 5 and np.allclose(p, probabilities(train, 3, model), atol=1e-9)


def test_perceptron_by_hand(train):
    vectors, x = vectors_of(train)
    model = members.fit_members(train, {4: members.perceptron_member(vectors, 4, hidden=6, max_iter=20)})[4]
    w = model.stages[-1].weights.toArray()
    # layer by layer: a matrix in columns of inputs, then the offsets
    inner, rest = w[:4 * 6].reshape(4, 6), w[4 * 6:]
    outer, last = rest[6:6 + 6 * 3].reshape(6, 3), rest[6 + 6 * 3:]
    hidden = 1 / (1 + np.exp(-(x @ inner + rest[:6])))
    assert np.allclose(softmax(hidden @ outer + last), probabilities(train, 4, model), atol=1e-6)


def test_a_missing_prediction_is_a_miss_in_selection(train):
    models = [("low", members.logistic_member(WORDS, reg=5.0)), ("right", members.logistic_member(WORDS, reg=0.001))]
    unlabelled = train.withColumn("label_id", F.when(F.col("post_id") > 0, F.col("label_id")))
    _, tried = members.select_on_validation(train, unlabelled, models, 1)
    found = {r["candidate"]: r["val_accuracy"] for r in tried.collect()}
    assert found["right"] == 0.9 and found["low"] <= found["right"]
