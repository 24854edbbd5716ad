"""Best-fit packing of texts into sequences of several permitted lengths.

Lengths and capacities are counted in words and an end token, unless another count is given: a sequence that is full by
words can be longer than its capacity once a tokenizer has cut the words into pieces.

A text's tokens are cut into pieces of the longest permitted length and a rest. Best-fit decreasing sees pieces of equal
length as alike, so it runs on their counts alone: a table with a row for each length up to the longest permitted
one, whatever the corpus. Going down the lengths, pieces fill the open bins of least room that still take them, each
as full as it gets; when none does, a bin opens at the permitted length of least cost per token that it can take of
this length, where the cost of a bin grows faster than its length. In the end every bin shrinks to the least permitted
length that holds its contents. What comes out are bin patterns with how often each is used; pieces then find
their places by their rank among pieces of their length, looked up by binary search in the tasks.

Ranks come from counts of (length, hash bucket) and a place inside the bucket, so a length that a third of all texts
share is ranked by many tasks.

Edge cases: null and empty texts are their end token alone; ids may be null or repeated, every row is packed; an
empty table gives no bins. Only the two named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpmill.session import stage

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of one length that one task ranks, about.
RANKED = 1000


def bin_cost(capacity: int) -> float:
    """Work for a sequence: linear in its tokens, and more by attention (as much again at 16,384 tokens)."""
    return capacity * (1 + capacity / 16384)


def word_tokens(text: Column) -> Column:
    """Tokens of a text counted as words, and its end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1).cast("long")


def best_capacity(length: int, left: int, capacities: Sequence[int], cost: Callable[[int], float]) -> int:
    """Where to open a bin for a piece, when ``left`` pieces of its length are still to be placed."""
    return min((c for c in capacities if c >= length),
               key=lambda c: (cost(c) / (min(c // length, left) * length), c))


def pack_counts(counts: dict[int, int], capacities: Sequence[int], cost: Callable[[int], float] = bin_cost):
    """Patterns ``(capacity, used, times, ((length, how many), ...))`` that place every piece once."""
    capacities = sorted(capacities)
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[int, tuple]]] = {}

    def put(room: int, times: int, contents: tuple) -> None:
        if times:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((times, contents))

    def take(room: int) -> tuple[int, tuple]:
        group = open_bins[room].pop()
        if not open_bins[room]:
            del open_bins[room]
            rooms.remove(room)
        return group

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, contents = take(room)
            else:
                capacity = best_capacity(length, left, capacities, cost)
                most = max(c // length for c in capacities if c >= length)
                # as long as a bin of any permitted length could be filled, the choice stays the same
                times = max(1, (left - most) // (capacity // length)) if left > most else 1
                room, contents = capacity, ()
            each = room // length
            full = min(times, left // each)
            put(room - each * length, full, contents + ((length, each),))
            left -= full * each
            times -= full
            if times and left:
                put(room - left * length, 1, contents + ((length, left),))
                times, left = times - 1, 0
            put(room, times, contents)
    out = []
    for room in sorted(open_bins):
        for times, contents in open_bins[room]:
            used = sum(n * k for n, k in contents)
            out.append((next(c for c in capacities if c >= used), used, times, contents))
    return out


def pieces(docs: DataFrame, length: Column, longest: int, id_col: str) -> DataFrame:
    """``doc_id, piece, start, length``: the cuts of every text."""
    return (
        docs.select(F.col(id_col).alias("doc_id"), length.alias("tokens"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, cast(ceil(tokens / {longest}) as bigint) - 1L)")))
        .select("doc_id", "piece", (F.col("piece") * longest).alias("start"),
                F.least(F.lit(longest), F.col("tokens") - F.col("piece") * longest).cast("int").alias("length"))
    )


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add the rank of each piece among pieces of its length; ``counts`` has a row for each length at most."""
    buckets = rows.sparkSession.createDataFrame(
        [(n, -(-k // RANKED)) for n, k in counts.items()], "length int, buckets long")
    rows = rows.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    counted = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("length", "bucket", F.coalesce(upto, F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place")).drop("bucket", "place", "before")
    )


def slots(patterns) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of places in order of rank: first rank, first bin, first token in the bin, bin size."""
    out: dict[int, list] = {}
    first_bin, given = 0, {}
    for capacity, _, times, contents in patterns:
        at = 0
        for length, many in contents:
            for _ in range(many):
                out.setdefault(length, []).append((given.get(length, 0), first_bin, at, capacity))
                given[length] = given.get(length, 0) + times
                at += length
        first_bin += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*runs)) for n, runs in out.items()}


def _placed(held):
    names = ["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_start"]

    def run(batches):
        table = held.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            out = np.zeros((3, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    ranks, bins, at, capacity = table[int(length[part[0]])]
                    run_no = np.searchsorted(ranks, rank[part], "right") - 1
                    out[0, part] = bins[run_no] + rank[part] - ranks[run_no]
                    out[1, part], out[2, part] = capacity[run_no], at[run_no]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(out[0]), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=names)
    return run


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text",
         length: Column | None = None) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, bin_capacity, bin_start``: the place of every piece of every text.

    ``length`` (a positive number of tokens) may be given by another tokenizer; by default words are counted.
    """
    spark = docs.sparkSession
    rows = stage(pieces(docs, word_tokens(F.col(text_col)) if length is None else length, max(capacities), id_col), "pack-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    held = spark.sparkContext.broadcast(slots(pack_counts(counts, capacities)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return ranked(rows, counts).select("doc_id", "piece", "start", "length", F.col("rank").cast("long").alias("rank")).mapInArrow(
        _placed(held),
        f"doc_id {kind}, piece bigint, start bigint, length int, bin_id bigint, bin_capacity int, bin_start int")
