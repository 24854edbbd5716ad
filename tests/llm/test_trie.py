import random

import pytest
from pyspark.sql import functions as F
from sql import same_as_sql, write

from chirpmill.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth long, hi string, band int"


def talks(rng, n, most, words):
    said = lambda: (rng.choice(["user", "assistant", None]), rng.choice(words))
    opening = [[said() for _ in range(4)] for _ in range(3)]
    rows = []
    for c in range(-30, n):
        if rng.random() < .15:
            continue
        told = (rng.choice(opening)[:rng.randint(0, 4)] + [said() for _ in range(rng.randint(0, most))])[:most]
        rows += [(c, t if rng.random() < .95 else None, *turn, 7, "x", 1) for t, turn in enumerate(told)]
    return rows


@pytest.mark.parametrize("seed, most", [(1, 3), (2, 12), (3, 40)])
def test_equals_sql(spark, tmp_path, monkeypatch, seed, most):
    monkeypatch.setattr(trie, "ENDS", 2)
    rng = random.Random(seed)
    rows = talks(rng, 120, most, ["", None, "a b", "c", " d\te "])
    rows += rng.sample(rows, 20)
    rows += [(None, 1, "user", "no conversation", 7, "x", 1)] * 3 + [(500, None, None, None, 7, "x", 1)]
    rng.shuffle(rows)
    assert same_as_sql(spark, write(spark, tmp_path, conversations=(rows, TURNS)), "op12_prefix_trie", "conversations") == "ok"


def test_a_conversation_that_holds_most_rows_fills_several_ranges(spark, tmp_path):
    rng = random.Random(9)
    rows = [(40, t, "user", rng.choice(["a", "b c"]), 7, "x", 1) for t in range(900)]
    rows += [(41, t, "user", r[3], 7, "x", 1) for t, r in enumerate(rows[:700])] + talks(rng, 60, 4, ["x", "y z"])
    folder = write(spark, tmp_path, conversations=(rows, TURNS))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges stay apart, as large ones do
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        turns = trie.numbered(spark.read.parquet(f"{folder}/conversations.parquet"))
        assert turns.where("conv_id = 40").select("part").distinct().count() > 1
        assert same_as_sql(spark, folder, "op12_prefix_trie", "conversations") == "ok"
    finally:
        spark.conf.set(name, before)


def test_band_height_changes_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(talks(random.Random(4), 80, 30, ["a", "b"]), TURNS)
    results = []
    for least in (2, 5, 64):
        monkeypatch.setattr(trie, "LEAST_HEIGHT", least)
        monkeypatch.setattr(trie.math, "isqrt", lambda _: 0)
        results.append(sorted(trie.nodes(rows).collect(), key=str))
    assert results[0] == results[1] == results[2] and results[0]


def test_empty_table_and_turnless_rebuilds(spark):
    assert trie.nodes(spark.createDataFrame([], TURNS)).collect() == []
    # conversations without a base whose own turns are all skipped have no turn left
    rows = spark.createDataFrame([(c, 0, "user", "x", 7, "x", 1) for c in (21, 22, 23, 24)], TURNS)
    skipped = rows.where(F.crc32(F.col("conv_id").cast("string")) % 4 > 0).count()
    assert skipped
    found = {r.depth: r for r in trie.nodes(rows).collect()}
    assert found[0].n_convs == 4 and found.get(1) is None or found[1].n_convs == 4 - skipped
