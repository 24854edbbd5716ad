import random

from pyspark.sql import functions as F
from sql import same_as_sql, write

from chirpmill.llm import jaccard
from chirpmill.llm.components import components

SCHEMA = "doc_id long, text string"


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    word = lambda: f"v{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(30))
    base = [" ".join(word() for _ in range(rng.choice([6, 20, 60, 150]))) for _ in range(25)]
    rows = []
    for i in range(230):
        text = rng.choice(base)
        if rng.random() < .75:
            text = changed(rng, text, rng.randint(0, 1 + len(text.split()) // 25))
        if rng.random() < .3:
            text += " " + passage
        rows.append((i, text.upper() if i % 3 else text))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  B"), (1005, "a"), (1006, "b a"), (1007, base[3] * 400)]
    # a large group of near copies that the walk has to sort out
    rows += [(2000 + i, changed(rng, base[0] + " " + passage + " " + base[1], rng.randint(2, 9))) for i in range(120)]
    return rows


def test_equals_sql(spark, tmp_path):
    folder = write(spark, tmp_path, documents=(corpus(random.Random(8)), SCHEMA))
    assert same_as_sql(spark, folder, "op2_jaccard", "documents") == "ok"


def test_trees_alone_find_every_link(spark, monkeypatch):
    """With small leaves, and every member in a component of its own, the walk has to keep all similar pairs."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "FAN", 2)
    docs = spark.createDataFrame(corpus(random.Random(9)), SCHEMA)
    made = jaccard.sets(docs, "doc_id", "text")
    member = jaccard.blocks(docs, made, "text")
    ids = made.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    whole = docs.join(ids, "doc_id").select("sid", "text").mapInArrow(
        jaccard._whole_rows, "sid bigint, n bigint, bits array<bigint>, hidden bigint, tokens binary").cache()
    pairs = jaccard.tree_pairs(member.select("block", "sid", F.col("sid").alias("component")), whole)
    got = {(r["a"], r["b"]) for r in jaccard.verified(pairs, whole).collect()}
    rows = [(r["sid"], set(memoryview(r["tokens"]).cast("Q"))) for r in whole.collect()]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if 100 * len(x & y) >= 75 * len(x | y)}
    assert len(want) > 100 and got == want


def test_different_sets_with_one_digest(spark):
    docs = spark.createDataFrame(corpus(random.Random(10))[:200], SCHEMA)
    assert jaccard.sets(docs, "doc_id", "text", bits=4).where("sid = second").count() > 100
    rows = [sorted(map(tuple, jaccard.classes(docs, bits=b).collect())) for b in (4, 64)]
    assert rows[0] == rows[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "x"), (8, "x"), (None, None)], SCHEMA)
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in
                  jaccard.classes(docs.withColumn("sid", F.lit("s")).withColumn("n", F.lit(2))).collect()), key=str)
    assert len(got) == 5 and {g for g in got if g[0] == 8} == {(8, 1, 7)}
    assert (-1, 2, 7) in got and (-1, 0, None) in got
    assert jaccard.classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 40)] + [(39, 300), (300, 301), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [*range(5, 40), 300, 301]}}


def test_what_stands_before_the_shared_shingle_rules_out_no_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "FAN", 2)
    docs = spark.createDataFrame(corpus(random.Random(11)), SCHEMA)
    made = jaccard.sets(docs, "doc_id", "text")
    whole = jaccard.whole_sets(docs, made, "doc_id", "text").cache()
    member = jaccard.blocks(docs, made, "text", whole=whole)
    pairs = jaccard.tree_pairs(member.select("block", "sid", F.col("sid").alias("component"), "most"), whole)
    got = {(r["a"], r["b"]) for r in jaccard.verified(pairs, whole).collect()}
    rows = [(r["sid"], set(memoryview(r["tokens"]).cast("Q"))) for r in whole.collect()]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if 100 * len(x & y) >= 75 * len(x | y)}
    assert len(want) > 100 and got == want


def test_few_pairs_of_a_large_group_are_looked_at(spark, monkeypatch):
    """Copies of one text that are similar to no other: pairs grew with the square of the group."""
    rng, walk, seen = random.Random(12), jaccard.tree_pairs, []

    def counted(members, whole):
        pairs = walk(members, whole).cache()
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "tree_pairs", counted)
    base = " ".join(f"v{i}" for i in range(150))
    rows = [(i, changed(rng, base, 9)) for i in range(250)]
    got = jaccard.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 250 and sum(r["component_id"] == r["doc_id"] for r in got) > 240
    assert len(seen) == 1 and seen[0] < 500
