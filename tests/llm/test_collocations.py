import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from sql import same_as_sql, write

from chirpmill.llm import collocations, importable

DOCS = "doc_id long, text string, lang string, pair string, third string, word string"


def rows(rng):
    word = lambda: rng.choice(["The", "of", "la", "É", "x-1", "日本", "a\x0bb", "ha", "(q)"])
    long = " ".join(f"w{i}" for i in range(70))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts = [rng.choice(["{}", "{}. {}", "{},{}\n{}", "\t{} ;", "x{}"]).replace("{}", t) for t in texts]
    texts += ["tail " + long for _ in range(3)] + ["ha " * 500 + "!", "", "..", " \t ", "x" * 90_000]
    docs = [(i, t, rng.choice(["en", "fr", "", None, "a b\tc"]), "p", "t", "w") for i, t in enumerate(texts)]
    docs += [(i, f"{long}. {texts[i]}", "en", "p", "t", "w") for i in range(14)]
    docs += docs[:25] + [(None, None, None, "p", "t", "w"), (7, None, "en", "p", "t", "w")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, block, heavy, merge", [(1, 1024, 10 ** 6, 6 << 20), (2, 3, 40, 6 << 20), (3, 7, 10, 30), (4, 9, 10 ** 6, 1)])
def test_equals_sql(spark, tmp_path, monkeypatch, seed, block, heavy, merge):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "HEAVY_RUNS", heavy)
    monkeypatch.setattr(collocations, "MERGE_BYTES", merge)
    folder = write(spark, tmp_path, documents=(rows(random.Random(seed)), DOCS))
    assert same_as_sql(spark, folder, "op13_collocations", "documents") == "ok"


@pytest.mark.parametrize("docs", [[], [(1, "...", "en", "p", "t", "w")], [(1, "a b c " * 3, "en", "p", "t", "w")]])
def test_tables_without_frequent_phrases(spark, tmp_path, docs):
    folder = write(spark, tmp_path, documents=(docs, DOCS))
    assert same_as_sql(spark, folder, "op13_collocations", "documents") == "ok"
    assert collocations.collocations(spark.read.parquet(f"{folder}/documents.parquet")).count() == 0


def test_chunks_cover_every_byte_once_and_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 20)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab .") for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(30)] + ["c" * 90]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    found, at = Counter(), 0
    for row, last, start, end in collocations._chunks(offsets, data):
        assert start == at and (end in offsets or data[end - 1] == ord("."))
        at = end
        c = collocations._coded(pa.array(["x"] * (last - row)), np.clip(offsets[row:last + 1], start, end) - start, data[start:end])
        for r in collocations._block(c, {("x", "b"): 3}).to_pylist() if c else []:
            assert (r["share"] == 0) or r["word"] == "b"
            for line in r["runs"].split("\n"):
                second, third, n = line.split(" ")
                found[r["word"], second, third] += int(n)
    assert at == len(data)
    said = Counter()
    for piece in (p.split() for t in texts for p in t.split(".")):
        for i in range(len(piece)):
            said[tuple((piece[i:i + 3] + ["", ""])[:3])] += 1
    assert found == said


def test_paths_hold_every_frequent_edge_once(spark):
    importable(spark)
    docs = spark.createDataFrame(rows(random.Random(8)), DOCS)
    found = collocations.edges(collocations.flows(docs))
    blocks = collocations.paths(found).collect()
    runs = Counter((b.lang, *b.words[i:i + 3], b.weight) for b in blocks for i in range(len(b.words) - 2))
    assert runs == Counter((e.lang, *e.pair.split(" "), e.third, e.weight) for e in found.collect())
    assert max(len(b.words) for b in blocks) >= 69 and max(runs.values()) == 1


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    told = spark.createDataFrame(
        [("node", "en", "a b", None, big), ("node", "en", "b c", None, big + 7), ("edge", "en", "a b", "c", big // 3),
         ("word", "en", "a", None, big + 11), ("word", "en", "b", None, big + 12), ("word", "en", "c", None, 2 * big + 1)],
        "kind string, lang string, pair string, third string, total long")
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in collocations.scored(told).collect()}
    a, b, c = big + 11, big + 12, 2 * big + 1
    assert set(got) == {"a b", "b c", "a b c"}
    assert got["a b"] == (big, a, b, a + b + c, 10 ** 6 * big * big // (a * b))
    t = big // 3
    low = min((10 ** 6 * t * t // (a * (big + 7)), 1, a, big + 7), (10 ** 6 * t * t // (big * c), 2, big, c))
    assert got["a b c"] == (t, low[2], low[3], a + b + c, low[0])


def test_few_words_are_heavy_at_any_size(spark, monkeypatch):
    importable(spark)
    docs = spark.createDataFrame([(1, "a " * 50 + "b " * 30 + "c d e f g", "en", "p", "t", "w"), (2, "a", None, "p", "t", "w")], DOCS)
    monkeypatch.setattr(collocations, "HEAVY_RUNS", 20)
    assert collocations.heavy_words(docs) == {("en", "a"): 3, ("en", "b"): 2}
    monkeypatch.setattr(collocations, "MOST_HEAVY", 2)
    assert collocations.heavy_words(docs) == {("en", "a"): 3}
