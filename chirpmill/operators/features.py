"""What members read from the words of a text, worked out beside each other in one Arrow step.

The words of a batch are looked up once. From their numbers follow the counts of words, the counts of listed runs of words and
means of word vectors: what a look-up and the stages behind it (``CountVectorizerModel``, ``NGram``, ``Word2VecModel``) give, without
a string for each word or run of words. Runs are found from their first word on, as paths in a tree of the listed ones, so a place
where no listed run opens is left after one step. Rows are worked off as many at a time as have ``PLACES`` words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .dictionary import Dictionary

#: Words that are worked off at once, and words of one row whose vectors a task holds at once.
PLACES, LONG = 1 << 18, 1 << 14


@dataclass
class Features:
    """What is asked for of texts whose words are numbered by ``words``; the number behind the last is any other word's."""

    words: list[str]
    #: Columns that count words.
    counts: list[str] = field(default_factory=list)
    #: Columns that count runs of words: the length and the runs, as numbers of words, in the order of their places.
    runs: dict[str, tuple[int, list[tuple[int, ...]]]] = field(default_factory=dict)
    #: Means of vectors, a row for each number, and the columns that hold them.
    means: list[tuple[np.ndarray, list[str]]] = field(default_factory=list)

    def add_mean(self, vectors: np.ndarray, name: str) -> None:
        for known, names in self.means:
            if np.array_equal(known, vectors):
                names.append(name)
                return
        self.means.append((vectors, [name]))


def _tree(runs: dict[str, tuple[int, list[tuple[int, ...]]]], span: int) -> list[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """For each length from 2 on: the openings of listed runs as parent times ``span`` plus the last word, and the places of those that end there."""
    levels, known = [], None
    for n in range(2, max((n for n, _ in runs.values()), default=1) + 1):
        heads = sorted({run[:n] for size, listed in runs.values() if size >= n for run in listed})
        keys = np.array([(known[h[:-1]] if known else h[0]) * span + h[-1] for h in heads], np.int64)
        known = {h: i for i, h in enumerate(heads)}
        ends = {}
        for name, (size, listed) in runs.items():
            if size == n:
                ends[name] = np.full(len(heads), -1)
                ends[name][[known[run] for run in listed]] = np.arange(len(listed))
        levels.append((keys, ends))
    return levels


def _reader(asked: Features, sent: list):
    """Tokens of a batch of texts to one struct of vectors: the counts, the runs and the means."""
    unknown = len(asked.words)
    numbered, span = Dictionary({w: i for i, w in enumerate(asked.words)})._numbers(unknown), unknown + 1
    levels, counted = _tree(asked.runs, span), bool(asked.counts)
    sizes_of = {name: len(listed) for name, (_, listed) in asked.runs.items()}
    at_once, long = PLACES, LONG

    def vectors(kind, size, indices, values):
        return pa.StructArray.from_arrays([pa.array(kind, pa.int8()), size, indices, values], ["type", "size", "indices", "values"])

    def sparse(keys, n, places):
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        ends = pa.array(np.searchsorted(keys[first], np.arange(n + 1) * places).astype(np.int32))
        return vectors(
            np.zeros(n, np.int8), pa.array(np.full(n, places, np.int32)),
            pa.ListArray.from_arrays(ends, pa.array((keys[first] % places).astype(np.int32))),
            pa.ListArray.from_arrays(ends, pa.array(np.diff(first, append=len(keys)).astype(np.float64))))

    def runs(ids, row, n):
        x, node, found = np.arange(len(ids)), ids, {}
        for last, (keys, ends) in enumerate(levels, 1):
            inside = x + last < len(ids)
            x, node = x[inside], node[inside]
            inside = row[x] == row[x + last]
            x, node = x[inside], node[inside]
            at = pc.fill_null(pc.index_in(pa.array(node * span + ids[x + last]), pa.array(keys)), -1).to_numpy(zero_copy_only=False)
            x, node = x[at >= 0], at[at >= 0].astype(np.int64)
            for name, places in ends.items():
                place = places[node]
                found[name] = sparse(row[x[place >= 0]] * sizes_of[name] + place[place >= 0], n, sizes_of[name])
        return [found[name] for name in sizes_of]

    def means(table, ids, ends):
        n, width = len(ends) - 1, table.shape[1]
        out = np.zeros((n, width))
        for i in range(n):
            for start in range(ends[i], ends[i + 1], long):
                some = table[ids[start:min(start + long, ends[i + 1])]]
                if start > ends[i]:
                    some = np.vstack([out[i], some])
                out[i] = np.add.reduce(some, axis=0, dtype=np.float64)
        sizes = np.diff(ends)
        said = sizes > 0
        out = out[said] * (1.0 / sizes[said])[:, None]
        # a text without words has the empty sparse vector
        edges = pa.array(np.concatenate([[0], np.cumsum(said * width)]).astype(np.int32))
        none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()), mask=pa.array(said))
        return vectors(said.astype(np.int8), pa.array(np.full(n, width, np.int32), mask=said), none,
                       pa.ListArray.from_arrays(edges, pa.array(out.ravel())))

    def read(texts):
        numbers, sizes = numbered(texts)
        ids, edges = numbers.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        parts, start = [], 0
        while start < len(sizes) or not parts:
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + at_once, "right")) - 1) if len(sizes) else 0
            own, ends = ids[edges[start]:edges[stop]], edges[start:stop + 1] - edges[start]
            row = np.repeat(np.arange(stop - start), np.diff(ends))
            found = [sparse(row * span + own, stop - start, span)] if counted else []
            found += runs(own, row, stop - start) if levels else []
            found += [means(table.value, own, ends) for table in sent]
            parts.append(found)
            start = stop
        whole = [pa.concat_arrays(some) for some in zip(*parts)]
        return pa.StructArray.from_arrays(whole, [f"f{i}" for i in range(len(whole))], mask=texts.is_null())

    read.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return read


def with_features(df: DataFrame, asked: Features, words: str = "tokens") -> DataFrame:
    """``df`` with the columns that ``asked`` names, from the array of words in ``words``; NULL stays NULL.

    Columns carry their width, so that no stage behind has to look at a row for it.
    """
    sent = [df.sparkSession.sparkContext.broadcast(np.asarray(table, np.float32)) for table, _ in asked.means]
    held = [asked.counts] * bool(asked.counts) + [[name] for name in asked.runs] + [names for _, names in asked.means]
    widths = [len(asked.words) + 1] * bool(asked.counts) + [len(listed) for _, listed in asked.runs.values()] + [table.shape[1] for table, _ in asked.means]
    shape = StructType([StructField(f"f{i}", VectorUDT()) for i in range(len(held))])
    read = df.withColumn("features_read", F.arrow_udf(_reader(asked, sent), shape)(F.col(words)))
    return read.select(*df.columns, *[
        F.col(f"features_read.f{i}").alias(name, metadata={"ml_attr": {"num_attrs": width}})
        for i, (names, width) in enumerate(zip(held, widths)) for name in names])
