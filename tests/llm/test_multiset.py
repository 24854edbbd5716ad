import hashlib
import random

import numpy as np
import pytest
from sql import same_as_sql, write

from chirpmill.llm import importable, multiset

DOCS = "doc_id long, text string, place string, key string, tie string"


def rows(rng):
    word = lambda: rng.choice(["Ab", "b", "c-d", "é", "x1", "the", "of", "Z", "日本", ""])
    text = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8)))
    docs = [(i * 3 - 50, text()) for i in range(60)]
    docs += [(7, text()) for _ in range(40)] + [(None, text()) for _ in range(30)]
    docs += [(7, "same\ntext")] * 5 + [(None, None), (1000, None), (-1000, ""), (5, "q " * 30_000 + "\n" + "one\ntwo " * 9_000)]
    rng.shuffle(docs)
    return [(*d, "a", "b", "c") for d in docs]


@pytest.mark.parametrize("size", [64 << 20, 4000, 300])
def test_equals_sql_in_one_and_in_many_ranges(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(multiset, "RANGE_BYTES", size)
    folder = write(spark, tmp_path, documents=(rows(random.Random(size)), DOCS))
    assert same_as_sql(spark, folder, "op11_fingerprints", "documents") == "ok"


def test_one_row_and_no_row(spark, tmp_path):
    assert same_as_sql(spark, write(spark, tmp_path / "a", documents=([(4, "a b\nc d", "", "", "")], DOCS)),
                       "op11_fingerprints", "documents") == "ok"
    assert same_as_sql(spark, write(spark, tmp_path / "b", documents=([], DOCS)), "op11_fingerprints", "documents") == "ok"


def test_small_pieces_change_nothing(monkeypatch):
    texts = ["a b c\nd e f", "", "x\n" * 9, "a b c d e"] * 3
    whole = [r for r in multiset._compared(list(range(len(texts))), texts, "int64").to_pylist()]
    for i in range(len(texts) - 1):
        assert multiset._compared([i], texts[i:i + 2], "int64").to_pylist() == whole[i:i + 1]


def test_order_does_not_matter_and_counts_do():
    a, b, c, d = multiset.vectors(["x y\nz\nx y", "z\nx y\nx y", "z\nx y", "z\nx y\nx  y"])
    assert (a == b).all() and not (a == c).all() and not (a == d).all()


def test_insert_and_delete(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, "a\nb\nc", "d\ne", "b"), (2, "", "x", None), (3, None, None, None)],
                                 "doc_id long, text string, plus string, minus string")
    first = multiset.fingerprints(docs).join(docs, "doc_id")
    got = {r.doc_id: r.fingerprint for r in multiset.updated(first, "fingerprint", "plus", "minus").collect()}
    assert [got[i] for i in (1, 2, 3)] == multiset.shown(multiset.vectors(["e\na\nc\nd", "x\n", ""]))
    assert (multiset.read(got[1]) == multiset.vectors(["a\nc\nd\ne"])[0]).all()


def test_likeness_follows_shared_runs():
    rng = random.Random(5)
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(3000)]
    for kept in (1.0, .9, .5, .1, 0.0):
        n = 600
        a = [rng.choice(words) for _ in range(n)]
        b = a[:int(kept * n)] + [rng.choice(words) for _ in range(n - int(kept * n))]
        x, y = multiset.vectors([" ".join(a), " ".join(b)])
        assert abs(multiset.likeness(x[None], y[None])[0] - kept / (2 - kept)) < .2
    assert multiset.likeness(*np.array([multiset.vectors(["a  b"]), multiset.vectors(["a b"])])[:, :1].reshape(2, 1, -1))[0] == 1.0
    assert multiset.likeness(multiset.vectors(["."]), multiset.vectors(["\n"]))[0] == 0.0
