"""Word vectors from counts: what stands near what, weighted by pointwise mutual information, in few dimensions.

Words within ``WINDOW`` places of each other count ``NEAR / distance``, in whole numbers, so the counts do not depend on how
rows are dealt or summed (``cooccurrence``). Counts that exceed chance become positive pointwise mutual information, kept as
one sorted sparse row a word (``information``). The leading directions of that symmetric matrix are found by block power
iteration from seeded numbers: Spark multiplies the rows with the block, each row's terms in the order of their ids, and the
driver makes the block orthonormal, ``ROUNDS`` times; directions are then scaled by the root of their size. Two runs give equal
vectors, whatever the partitions.

A block is ``max_words`` x ``size`` numbers, 40 MB for 25,000 words and 200 places; it goes to the driver and back each round.
Its bound is checked. Everything that grows with the texts stays in Spark: the counts have partial sums in each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import MAX_WORDS, SEED, VECTOR_SIZE
from ..session import stage, work_path

WINDOW = 5
#: The least common multiple of the distances.
NEAR = 60
ROUNDS = 5
#: Words whose pairs a task holds at once: some 100 MB.
PLACES = 1 << 19


def cooccurrence(df: DataFrame, sequence: str = "sequence", times: str | None = None, window: int = WINDOW) -> DataFrame:
    """``(a, b, n)`` for ids ``a <= b``, none below 0: how near and how often they stand together; ``times`` says how often a row counts.

    A task adds up the pairs of ``PLACES`` words at a time before Spark sums them.
    """
    if NEAR % np.lcm.reduce(np.arange(1, window + 1)):
        raise ValueError(f"{NEAR} is not divided by all distances up to {window}")

    def opened(ids, known, row, often, start, end):
        # pairs that open at the places from start to end of rows laid behind each other
        near, far, n = [], [], []
        for d in range(1, window + 1):
            x = np.arange(start, min(end, len(ids) - d))
            x = x[row[x] == row[x + d]]
            y = x + d
            # a place without an id stands for the other one
            x, y = np.where(known[x], x, y), np.where(known[y], y, x)
            near.append(np.minimum(ids[x], ids[y]) << 32 | np.maximum(ids[x], ids[y]))
            n.append(often[row[x]] * (NEAR // d))
            far.append(known[x])
        key, n, known = np.concatenate(near), np.concatenate(n), np.concatenate(far)
        lost, key, n = n[~known], key[known], n[known]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        key, n = key[first], np.add.reduceat(n[order], first) if len(first) else n
        a, b, n = pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(n, pa.int64())
        if len(lost):
            a, b, n = (pa.concat_arrays([v, pa.array([w], v.type)]) for v, w in ((a, None), (b, None), (n, lost.sum())))
        return pa.RecordBatch.from_arrays([a, b, n], names=["a", "b", "n"])

    def pairs(batches):
        for batch in batches:
            found = batch.column(1)
            flat, sizes = found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            ids = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            often = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(ids), PLACES):
                yield opened(ids, known, row, often, start, start + PLACES)

    often = F.col(times) if times else F.lit(1)
    near = df.select(often.cast("long").alias("often"), F.col(sequence).cast("array<int>")).where("often is not null")
    return near.mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def information(counts: DataFrame) -> DataFrame:
    """``(a, places, values)``: of each word the others that stand near it more than by chance, by id, and by how much.

    The value is ln(n(a, b) * N / (n(a) * n(b))), where n(a) and N sum both orders of a pair.
    """
    both = stage(
        counts.unionByName(counts.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
        .withColumn("n", F.expr("if(a = b, 2 * n, n)")), "both-orders")
    totals = both.groupBy("a").agg(F.sum("n").alias("n_a"))
    # a row for each word of a capped vocabulary
    whole = totals.agg(F.sum("n_a")).first()[0] or 0
    cells = both.join(totals, "a").join(totals.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b")
    ratio = F.col("n").cast("double") * float(whole) / (F.col("n_a").cast("double") * F.col("n_b").cast("double"))
    return (
        cells.select("a", "b", F.log(ratio).alias("v")).where("v > 0")
        .groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("cells"))
        .select("a", F.col("cells.b").alias("places"), F.col("cells.v").alias("values")))


def _product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix of ``rows`` times a block; words without a row give zeros."""
    spark, width = rows.sparkSession, block.shape[1]
    sent = spark.sparkContext.broadcast(block)

    def multiply(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            out = []
            for i in range(len(own)):
                at = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                out.append(np.einsum("i,ij->j", batch.column(2)[i].values.to_numpy(zero_copy_only=False), sent.value[at]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(out, pa.binary())], names=["a", "row"])

    result = np.zeros_like(block)
    for a, row in rows.mapInArrow(multiply, "a int, row binary").collect():
        result[a] = np.frombuffer(row, np.float64, width)
    sent.unpersist()
    return result


def leading(rows: DataFrame, n: int, size: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` x ``size``: the strongest directions of a symmetric matrix with ids below ``n``, scaled by the root of their size."""
    width = min(size, n)
    block = np.linalg.qr(np.random.RandomState(seed).standard_normal((n, width)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(_product(rows, block))[0]
    sizes, turn = np.linalg.eigh(block.T @ _product(rows, block))
    order = np.argsort(-np.abs(sizes), kind="stable")
    found = (block @ turn[:, order]) * np.sqrt(np.abs(sizes[order]))
    # a direction and its opposite are one: the largest entry is positive
    found *= np.where(found[np.abs(found).argmax(axis=0), np.arange(width)] < 0, -1.0, 1.0)
    return np.hstack([found, np.zeros((n, size - width))])


def fitted(rows: DataFrame, n: int, size: int = VECTOR_SIZE, seed: int = SEED, rounds: int = ROUNDS, limit: int = MAX_WORDS + 1) -> np.ndarray:
    if n > limit:
        raise ValueError(f"more than {limit} words")
    return leading(stage(rows, "information"), n, size, seed, rounds)


def vector_model(spark: SparkSession, words: list[str], vectors: np.ndarray, input_col: str = "known", output_col: str = "vector") -> Word2VecModel:
    """A model that averages the given vectors of the words of a row: the saved form of such a model with these vectors."""
    path = work_path(spark, "word-vectors")
    one = spark.createDataFrame([([w],) for w in words[:1]], f"{input_col} array<string>")
    Word2Vec(vectorSize=vectors.shape[1], minCount=0, inputCol=input_col, outputCol=output_col).fit(one).write().save(path)
    flat = pa.array(vectors.astype(np.float32).ravel())
    lists = pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * vectors.shape[1], flat)
    spark.createDataFrame(pa.table({"word": pa.array(words, pa.string()), "vector": lists})).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return Word2VecModel.load(path)
