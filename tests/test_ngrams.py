"""Frequent runs of words, by brute force."""

import random
from collections import Counter

import pytest

from chirpmill.operators import members, ngrams


def counted(rows, least, sizes=ngrams.SIZES):
    said = Counter()
    for ids, often in rows:
        for n in sizes:
            for i in range(len(ids or []) - n + 1):
                if 1 not in ids[i:i + n]:
                    said[n, tuple(ids[i:i + n])] += often
    return {k: c for k, c in said.items() if c >= least}


@pytest.mark.parametrize("seed, least", [(1, 2), (2, 5), (3, 40)])
def test_equal_to_counting_all_runs(spark, seed, least):
    rng = random.Random(seed)
    rows = [([rng.choice([1, 2, 2, 3, 4, 5]) for _ in range(rng.randint(0, 30))], rng.randint(1, 3)) for _ in range(60)]
    rows += [([7] * 50, 1), ([], 4), (None, 2), ([2, 3], 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "post_id long, sequence array<int>, times int")
    got = {(r.size, tuple(r.ids)): r.n for r in ngrams.frequent(df, times="times", least=least).collect()}
    assert got == counted(rows, least)
    assert {k for k in got if k[0] in (3, 5)} == {(r.size, tuple(r.ids)) for r in ngrams.frequent(
        df, times="times", least=least, sizes=(3, 5)).collect()}


def test_the_cap_keeps_the_most_frequent_of_each_size(spark):
    df = spark.createDataFrame([(2, [2, 3], 5), (2, [3, 2], 9), (2, [2, 4], 9), (3, [2, 2, 2], 1)], "size int, ids array<int>, n long")
    assert ngrams.most_frequent(df, ["a", "b", "c"], 2, most=2) == {2: ["a c", "b a"], 3: ["a a a"]}


def test_every_run_has_a_place_of_its_own(spark):
    rng = random.Random(6)
    rows = members.with_tokens(spark.createDataFrame(
        [(i, 0, " ".join(rng.choice("abcdef") for _ in range(12)), i % 2, 1.0) for i in range(80)],
        "post_id long, draw_no int, cleaned_text string, label_id int, weight double"))
    words = members.fitted_words(rows, max_words=7)  # one word is left out
    grams = members.fitted_grams(rows, words)
    model = members.ngram_bayes_member(words, grams).fit(rows)
    for row in model.transform(rows).select("known", "grams_2_to_5").collect():
        expected, at = Counter(), 0
        for n in ngrams.SIZES:
            place = {g: at + i for i, g in enumerate(grams.get(n, []))}
            at += len(grams.get(n) or [""])
            for i in range(len(row.known) - n + 1):
                g = " ".join(row.known[i:i + n])
                if g in place:
                    expected[place[g]] += 1
        v = row.grams_2_to_5
        assert v.size == at and {i: c for i, c in enumerate(v.toArray()) if c} == expected


def test_texts_without_a_frequent_run(spark):
    rows = members.with_tokens(spark.createDataFrame([(i, 0, f"w{i}", i % 2, 1.0) for i in range(6)],
                                                     "post_id long, draw_no int, cleaned_text string, label_id int, weight double"))
    words = members.fitted_words(rows)
    assert members.fitted_grams(rows, words) == {}
    assert members.ngram_bayes_member(words, {}).fit(rows).transform(rows).count() == 6
