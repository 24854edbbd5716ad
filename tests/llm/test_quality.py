import binascii

import numpy as np
from pyspark.sql import functions as F

from chirpmill.llm import quality
from chirpmill.llm.queries import QUERIES
from chirpmill.llm.wordhash import pieces
import pyarrow as pa

SCHEMA = "doc_id long, text string"


def by_paths(u, step):
    """Marginals by summing over all labellings."""
    n, total, good = len(u), 0.0, np.zeros(len(u))
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        weight = np.exp(sum(u[i] for i in range(n) if y[i]) + sum(step[y[i], y[i + 1]] for i in range(n - 1)))
        total += weight
        good += weight * np.array(y)
    return good / total


def test_marginals_equal_sum_over_labellings():
    rng = np.random.default_rng(0)
    count = np.array([3, 1, 6, 2, 7])
    u, step = rng.normal(size=count.sum()), rng.normal(size=(2, 2))
    forward, back, _ = quality._walk(u, count, step)
    got = forward * back[:, 1] / (forward * back[:, 1] + (1 - forward) * back[:, 0])
    at = 0
    for n in count:
        assert np.allclose(got[at:at + n], by_paths(u[at:at + n], step))
        at += n


def test_lines_are_those_of_the_text():
    texts = ["", "a\n", "\n", "b\n\nc d", "x", "", None, "\n\n"]
    (_, data, offsets), = pieces(pa.array(texts))
    lines = quality.describe(data, offsets)
    want = [line for t in texts for line in (t or "").split("\n")]
    assert lines.count.tolist() == [len((t or "").split("\n")) for t in texts]
    assert lines.size.tolist() == [len(x) for x in want]
    assert lines.x.shape[1] == quality.WIDTH


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op1_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 40
    for r in rows:
        assert r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)
    good = [r["score"] for r in out if r["quality"] == 1]
    bad = [r["score"] for r in out if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "Good line here.\nAnd one more." if i % 2 else "$$$ ### |||\n!!!") for i in range(40)]
        + [(100, None), (101, ""), (102, "\n\n"), (None, "Good line here."), (3, "Good line here.\nAnd one more."), (103, "x y\n" * 40000)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (100, None), (5, 7)], "doc_id long, quality int")
    field = quality.fit(docs, labels)
    rows = quality.score(docs.withColumn("score", F.lit("s")).withColumn("n_lines", F.lit(0)), field).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[100]["score"] == by[101]["score"] == by[102]["score"] == field.prior and by[103]["n_lines"] == 40001
    assert by[1]["score"] > 0.5 > by[2]["score"] and not by[None]["held_out"]
    kept = quality.accepted(docs.withColumn("c0", F.lit("x")), field)
    assert kept.columns == ["doc_id", "text", "c0"] and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a")], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5]
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.fit(empty, none)).collect() == []
