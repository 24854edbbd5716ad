"""Approximate nearest neighbours by cosine: probed lists scanned column block by column block.

Index: unit vectors go to the nearest of some centres. A random rotation spreads a vector's length evenly over its
columns, so the distance over the first columns foretells the whole. Search: each query probes the lists of its
nearest centres. Inside a list the columns are read in blocks; after each, a candidate is given up when its partial
distance, scaled up, is above the query's present k-th distance by more than chance explains (a test with bound
``1 + DOUBT / sqrt(columns read)``). What is left at the end is scored exactly, in double precision on the given vectors.

Only the rotation, the centres and the number of probed lists are fitted, on ``FIT`` vectors at most (those with the
smallest hash of their id): so many lists are probed as hold ``RECALL`` of the true neighbours inside that sample. Every
vector is indexed. Lists are cut into chunks of about ``CHUNK`` vectors and their queries into chunks as well, and
equal vectors inside a chunk are compared once, so a list or a vector that holds a third of all rows is many small tasks.

Edge cases: null and zero vectors and those with a null, NaN or infinite component take no part; vectors of different
lengths have no cosine, so each length has an index of its own, and more than ``MOST_WIDTHS`` lengths are an error; rows without
an id take no part; rows with equal id and vector count once; with fewer than k candidates all are returned; ties go to
the smaller id; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chirpmill.session import checked_small, stage

FIT = 16384
MOST_LISTS = 1024
MOST_WIDTHS = 64
ROUNDS = 8
TRIALS = 512
RECALL = 0.96
CHUNK = 4096
BLOCK = 16
DOUBT = 2.1


class Index(NamedTuple):
    rotation: np.ndarray
    centres: np.ndarray
    sizes: np.ndarray


def usable(vector: Column) -> Column:
    """Whether a vector can be compared."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled before squaring, so that no finite vector overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with ``q``; equal rows give equal values."""
    x, q = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    return (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum())


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit_index(sample: np.ndarray, total: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and the centres of about ``sqrt(total)`` lists."""
    width, rng = sample.shape[1], np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    x = unit(sample) @ rotation
    k = max(1, min(MOST_LISTS, len(x), round(math.sqrt(total))))
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=c, minlength=k) for c in x.T], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return rotation, centres


def fit_probes(sample: np.ndarray, index: Index, k: int) -> int:
    """How many lists hold ``RECALL`` of the ``k`` nearest of ``TRIALS`` different vectors of the sample."""
    trials = np.unique(sample, axis=0)
    trials = trials[np.random.default_rng(11).permutation(len(trials))[:TRIALS]]
    places = np.argsort(np.argsort(-_nearness(trials, index), axis=1, kind="stable"), axis=1)
    home, x, needed = np.argmax(_nearness(sample, index), axis=1), unit(sample), []
    for i in range(len(trials)):
        near = np.argsort(-(x @ unit(trials[i:i + 1])[0]), kind="stable")[1:k + 1]
        needed.append(places[i, home[near]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)))]) + 1 if len(needed) else 1


def _nearness(x: np.ndarray, index: Index) -> np.ndarray:
    return (unit(x) @ index.rotation) @ index.centres.T - (index.centres ** 2).sum(axis=1) / 2


def _assigned(held):
    def run(batches):
        index = held.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), index.rotation.shape[0])
                near = np.concatenate([np.argmax(_nearness(x[a:a + 4096], index), axis=1) for a in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "vector", "list"])
    return run


def _probed(held, probes: int, least: int):
    def run(batches):
        index = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                order = np.argsort(-_nearness(_matrix(part.column(1), index.rotation.shape[0]), index), axis=1, kind="stable")
                before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
                # enough lists for the asked number of neighbours, however small they are
                wanted = ((np.arange(order.shape[1]) < probes) | (before < least)) & (index.sizes[order] > 0)
                row, place = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(order[row, place], pa.int32())],
                    names=["query_id", "query", "list"])
    return run


def scan_list(x: np.ndarray, q: np.ndarray, keep: int) -> np.ndarray:
    """Rows of ``x`` that may be among the ``keep`` nearest to ``q``: column blocks with an early way out.

    ``x`` and ``q`` are rotated unit vectors.
    """
    width = x.shape[1]
    if len(x) <= keep:
        return np.arange(len(x))
    head = np.arange(min(len(x), 4 * keep))
    full = ((x[head] - q) ** 2).sum(axis=1)
    bound = np.partition(full, keep - 1)[keep - 1]
    alive = np.arange(len(head), len(x))
    partial = np.zeros(len(alive))
    for a in range(0, width, BLOCK):
        b = min(width, a + BLOCK)
        partial = partial + ((x[alive, a:b] - q[a:b]) ** 2).sum(axis=1)
        slack = (1 + DOUBT / math.sqrt(b)) ** 2 * b / width if b < width else 1
        stay = partial <= bound * slack + 1e-9
        alive, partial = alive[stay], partial[stay]
        if not len(alive):
            break
    rows, dist = np.concatenate([head, alive]), np.concatenate([full, partial])
    bound = np.partition(dist, keep - 1)[keep - 1]
    return rows[dist <= bound + 1e-9]


def _searched(held, k: int):
    names = ["query_id", "vec_id", "score"]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        index, out = held.value, ([], [], [])
        width = index.rotation.shape[0]
        if vectors.num_rows and queries.num_rows:
            raw, ids = _matrix(vectors["vector"], width), vectors["vec_id"].to_numpy()
            # equal vectors once, with the ids that can matter: k and one more, as a query leaves out its own
            order = np.lexsort((ids, *raw.T[::-1]))
            raw, ids = raw[order], ids[order]
            fresh = np.ones(len(raw), bool)
            fresh[1:] = (raw[1:] != raw[:-1]).any(axis=1)
            group = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            again = np.zeros(len(ids), bool)
            again[1:] = ~fresh[1:] & (ids[1:] == ids[:-1])
            ids, group = ids[~again], group[~again]
            begin = np.searchsorted(group, np.arange(len(first) + 1))
            raw = raw[first]
            x = unit(raw) @ index.rotation
            asked, who = _matrix(queries["query"], width), queries["query_id"].to_numpy()
            turned = unit(asked) @ index.rotation
            found: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            for i in range(len(who)):
                key = asked[i].tobytes()
                if key not in found:
                    rows = scan_list(x, turned[i], k + 1)
                    score = cosine(raw[rows], asked[i])
                    some = [ids[begin[r]:min(begin[r] + k + 1, begin[r + 1])] for r in rows]
                    many = np.array([len(s) for s in some])
                    near, value = np.concatenate(some), np.repeat(score, many)
                    best = np.lexsort((near, -value))[:k + 1]
                    found[key] = near[best], value[best]
                near, value = found[key]
                other = np.flatnonzero(near != who[i])[:k]
                out[0].append(np.full(len(other), who[i]))
                out[1].append(near[other])
                out[2].append(value[other])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=names)
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, probes: int | None = None, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found to each row for which ``is_query`` (over ``vec_id``) holds.

    ``probes`` sets the number of probed lists by hand.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    widths = checked_small(rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")), MOST_WIDTHS, "lengths of vectors").collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, [
        _search_width(rows.where(F.size("vector") == w["width"]), w["width"], w["n"], is_query, k, probes) for w in sorted(widths)])


def _search_width(rows: DataFrame, width: int, total: int, is_query: Column, k: int, probes: int | None) -> DataFrame:
    """``search`` among the ``total`` usable vectors of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).select("vector").toArrow()
    sample = _matrix(sample["vector"], width)
    rotation, centres = fit_index(sample, total)
    fitted = Index(rotation, centres, np.zeros(len(centres)))
    probes = probes or fit_probes(sample, fitted, k)
    share = spark.sparkContext.broadcast(fitted)
    listed = stage(rows.mapInArrow(_assigned(share), "vec_id bigint, vector array<double>, list int"), "vector-lists")
    # a row for each list, of which there are MOST_LISTS at most
    sizes = np.zeros(len(centres), np.int64)
    for name, n in listed.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[name] = n
    share = spark.sparkContext.broadcast(Index(rotation, centres, sizes))
    asked = listed.where(is_query).select("vec_id", "vector")
    probed = stage(asked.mapInArrow(_probed(share, probes, 8 * (k + 1)), "query_id bigint, query array<double>, list int"), "vector-probes")
    load = np.zeros(len(centres), np.int64)
    for name, n in probed.groupBy("list").agg(F.count("*").alias("n")).collect():
        load[name] = n
    cuts = spark.createDataFrame(
        [(i, -(-int(n) // CHUNK), -(-int(m) // CHUNK)) for i, (n, m) in enumerate(zip(sizes, load)) if n and m] or [(-1, 1, 1)],
        "list int, parts int, query_parts int")
    cuts = F.broadcast(cuts)
    left = (
        listed.join(cuts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
        .withColumn("query_part", F.explode(F.expr("sequence(0L, query_parts - 1L)")))
        .select("list", "part", "query_part", "vec_id", "vector")
    )
    right = (
        probed.join(cuts, "list").withColumn("query_part", F.pmod(F.xxhash64("query_id"), "query_parts"))
        .withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
        .select("list", "part", "query_part", "query_id", "query")
    )
    keys = ["list", "part", "query_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _searched(share, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
