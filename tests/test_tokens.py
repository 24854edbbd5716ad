"""Vocabulary, sequences and padding against plain Python."""

from collections import Counter

from pyspark.sql import functions as F

from chirpmill.functions.arrays import attention_mask, pad_left, pad_right, softmax
from chirpmill.operators import pooling, tokens

TEXTS = [(1, "b a b c"), (2, "c a d e"), (3, "e e f a"), (4, "z"), (5, "")]


def _texts(spark):
    return spark.createDataFrame(TEXTS, "post_id bigint, cleaned_text string").repartition(3)


def _python_vocabulary(cap):
    words = [w for _, s in TEXTS for w in s.split()]
    first = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    counts = Counter(words)
    kept = sorted(counts, key=lambda w: (-counts[w], first[w]))[:cap - 2]
    return {w: i + 2 for i, w in enumerate(kept)}


def test_vocabulary_follows_python(spark):
    for cap in (4, 6, 100):
        rows = tokens.fit_vocabulary(_texts(spark), max_words=cap).collect()
        assert {r["word"]: r["idx"] for r in rows} == _python_vocabulary(cap)


def test_weights_count_like_copies(spark):
    once = _texts(spark).withColumn("times", F.col("post_id"))
    copies = once.select("post_id", "cleaned_text", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    a = tokens.fit_vocabulary(once, weight="times").collect()
    b = tokens.fit_vocabulary(copies).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_sequences_follow_python(spark):
    vocabulary = tokens.fit_vocabulary(_texts(spark), max_words=5)
    known = _python_vocabulary(5)
    got = {r["post_id"]: list(r["sequence"]) for r in tokens.text_to_sequence(_texts(spark), vocabulary).collect()}
    assert got == {k: [known.get(w, 1) for w in s.split()] for k, s in TEXTS}


def test_padding_shapes(spark):
    df = spark.createDataFrame([(list(range(1, n + 1)),) for n in (0, 2, 3, 5)], "q array<int>")
    rows = df.select(pad_left(F.col("q"), 3), pad_right(F.col("q"), 3), attention_mask(F.col("q"), 3)).collect()
    assert [list(r[0]) for r in rows] == [[0, 0, 0], [0, 1, 2], [1, 2, 3], [3, 4, 5]]
    assert [list(r[1]) for r in rows] == [[0, 0, 0], [1, 2, 0], [1, 2, 3], [1, 2, 3]]
    assert [list(r[2]) for r in rows] == [[0, 0, 0], [1, 1, 0], [1, 1, 1], [1, 1, 1]]


def test_vocabulary_size_caps(spark):
    row = tokens.vocabulary_size(_texts(spark), max_words=6).first()
    assert tuple(row) == (8, 6)
    assert tuple(tokens.vocabulary_size(_texts(spark)).first()) == (8, 9)


def test_pools(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("a", [3.0, 1.0]), ("b", [2.0, 2.0])], "k string, v array<double>")
    assert {r["k"]: r["v"] for r in pooling.mean_pool(df, "k", "v").collect()} == {"a": [2.0, 3.0], "b": [2.0, 2.0]}
    assert {r["k"]: r["v"] for r in pooling.max_pool(df, "k", "v").collect()} == {"a": [3.0, 5.0], "b": [2.0, 2.0]}


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, 0.0), (-5.0, 0.0, 5.0)], "a double, b double, c double")
    rows = df.select(*softmax([F.col(c) for c in "abc"])).collect()
    assert tuple(rows[0]) == (0.5, 0.5, 0.0)
    assert abs(sum(rows[1]) - 1) < 1e-12


def test_trimming_before_the_lookup_changes_no_padded_row(spark):
    vocabulary = tokens.fit_vocabulary(_texts(spark), max_words=5)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for length in (1, 2, 3, 9):
        whole = tokens.text_to_sequence(_texts(spark), vocabulary)
        assert rows(tokens.with_padding(whole, length=length).select("post_id", "padded")) == rows(tokens.with_padding(
            tokens.text_to_sequence(_texts(spark), vocabulary, last=length), length=length).select("post_id", "padded"))
        columns = ("post_id", "input_ids", "attention_mask")
        assert rows(tokens.with_mask(whole, length=length).select(*columns)) == rows(tokens.with_mask(
            tokens.text_to_sequence(_texts(spark), vocabulary, first=length), length=length).select(*columns))
