import random

from pyspark.sql import functions as F

from chirpmill.llm import packing


def one_by_one(lengths, capacities, cost=packing.bin_cost):
    """Best-fit decreasing, a piece at a time."""
    lengths, bins = sorted(lengths, reverse=True), []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            left = sum(1 for m in lengths[i:] if m == n)
            size = packing.best_capacity(n, left, capacities, cost)
            b = [size, []]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
    return sorted(tuple(sorted(b[1])) for b in bins)


def test_counts_pack_like_single_pieces():
    rng = random.Random(5)
    for _ in range(60):
        capacities = sorted(rng.sample(range(4, 60), 3))
        lengths = [rng.randint(1, capacities[-1]) for _ in range(rng.randint(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        patterns = packing.pack_counts(counts, capacities)
        made = sorted(tuple(sorted(n for n, k in contents for _ in range(k)))
                      for _, _, times, contents in patterns for _ in range(times))
        assert sorted(x for b in made for x in b) == sorted(lengths)
        assert sum(map(len, made)) == len(lengths)
        for capacity, used, _, contents in patterns:
            assert used == sum(n * k for n, k in contents) <= capacity
            assert capacity == min(c for c in capacities if c >= used)
        reference = one_by_one(lengths, capacities)
        assert abs(len(made) - len(reference)) <= max(2, len(reference) // 10)


def check_bins(rows, capacities):
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append((r["bin_start"], r["length"], r["bin_capacity"]))
    for places in bins.values():
        at = 0
        for start, length, _ in sorted(places):
            assert start == at
            at += length
        sizes = {c for _, _, c in places}
        assert sizes == {min(c for c in capacities if c >= at)}
    assert sorted(bins) == list(range(len(bins)))


def test_pack_places_every_piece_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 3, 7, 7, 7, 30])))) for i in range(300)]
    rows += [(None, "a b"), (7, "a b c"), (7, "a b c"), (900, None), (901, " "), (902, "x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin_id", F.lit("mine")).withColumn("length", F.lit(None))
    got = packing.pack(docs, capacities=(8, 16, 32)).collect()
    check_bins(got, (8, 16, 32))
    want = sorted((-1 if i is None else i, len((t or "").split()) + 1) for i, t in rows)
    totals = {}
    for r in got:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        totals[key] = totals.get(key, 0) + r["length"]
    for key in totals:
        assert totals[key] == sum(n for i, n in want if i == key)
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 902)
    assert [p for p, _, _ in long] == list(range(16)) and all(s == 32 * p for p, s, _ in long)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
