import random

from pyspark.sql import functions as F
from sql import same_as_sql, write

from chirpmill.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def tables(rng):
    word = lambda: rng.choice(["Ab", "b", "c-d", "é", "x1", "the", "of", "Z"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 4, 7, 9, 10, 11, 14, 25, 60])))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "!!"), (53, items[9][1]), (11, "other text under an id that is used")]
    docs = []
    for i in range(80):
        text = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < .6:
            some = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(text))
            cut = rng.randint(0, max(0, len(some) - 12))
            text[at:at] = some[cut:cut + rng.randint(3, 40)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(100, None), (101, ""), (102, "..."), (103, "q " * 30000 + (items[8][1] + " ") * 3)]
    return docs, items


def test_equals_sql(spark, tmp_path):
    docs, items = tables(random.Random(4))
    folder = write(spark, tmp_path, documents=(docs, DOCS), benchmark=(items, ITEMS))
    assert same_as_sql(spark, folder, "op4_decontaminate", "documents", "benchmark") == "ok"


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h i j k"), (1, "a b c"), (1, "a b c d e f g h i j"), (1, "a b c")], DOCS)
    items = spark.createDataFrame([(None, "a b c d e f g h i j"), (5, "x")], ITEMS)
    rows, found = decontaminate.contamination(docs.withColumn("pos", F.lit("p")).withColumn("size", F.lit(3)), items.withColumn("print", F.lit(1)))
    got = sorted(((r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows.collect()))
    assert [g[:3] for g in got] == [(-1, 11, 10), (1, 3, 10), (1, 3, 10), (1, 10, 10)] and all(g[4] for g in got)
    none = spark.createDataFrame([], DOCS)
    assert decontaminate.contamination(none, items)[0].collect() == []
    clean = decontaminate.contamination(docs, spark.createDataFrame([], ITEMS))[0].collect()
    assert len(clean) == 4 and not any(r["contaminated"] for r in clean)
