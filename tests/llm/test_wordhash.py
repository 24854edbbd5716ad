import random

import numpy as np
import pyarrow as pa
import pytest
from sql import same_as_sql, write

from chirpmill.llm.wordhash import LETTERED, PLACES, SPACED, pieces, words


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def hashes(texts, kind=SPACED):
    out = []
    for first, data, offsets in pieces(pa.array(texts)):
        w = words(data, offsets, kind)
        out += [(first + int(t), texts[first + int(t)].encode()[s:e].lower(), int(h)) for t, s, e, h in zip(w.text, w.start, w.end, w.hash)]
    return out


def test_words_and_hashes(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é.\n日") for _ in range(rng.choice([0, 5, 40, 300]))) for _ in range(200)]
    texts += ["x" * n for n in (PLACES - 1, PLACES, PLACES + 1, 1000)] + ["", " "]
    for kind, ends in ((SPACED, " \n"), (LETTERED, " \n.")):
        found = hashes(texts, kind)
        split = [(i, w.lower()) for i, t in enumerate(texts) for w in "".join(" " if c in ends else c for c in t).encode().split()]
        assert [(i, w) for i, w, _ in found] == split
        by_word = {}
        for _, w, h in found:
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_words_made_of_two_interchanged_parts_differ(n):
    pair = [(thue_morse(n, *parts), thue_morse(n, *parts[::-1])) for parts in (("a", "b"), ("ab", "ba"), ("x", "yz"))]
    found = {h for _, _, h in hashes([w for p in pair for w in p])}
    assert len(found) == len({w for p in pair for w in p})


def test_such_words_make_no_link_and_no_hit(spark, tmp_path):
    one, other = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    text = "{} and some more words that stand in both of them here"
    docs = [(1, text.format(one)), (2, text.format(other)), (3, text.format(one))]
    folder = write(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(7, one), (8, "q")], "item_id long, text string"))
    assert same_as_sql(spark, folder, "op2_jaccard", "documents") == "ok"
    assert same_as_sql(spark, folder, "op4_decontaminate", "documents", "benchmark") == "ok"


def test_hashes_are_spread(monkeypatch):
    h = np.array([h for _, _, h in hashes([" ".join(f"{i:x}" for i in range(20_000))])], np.uint64)
    for bits in (h >> np.uint64(60), h & np.uint64(15)):
        assert np.abs(np.bincount(bits.astype(int), minlength=16) - 1250).max() < 200
