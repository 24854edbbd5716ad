"""Document quality from a linear-chain conditional random field over lines.

Every line is described by what its bytes and words look like (shares of character classes, lengths, repeated words),
cut at fixed levels into yes/no features; a line also sees the features of the line before and after it. The field
labels each line good or bad; its marginals come from the forward-backward rule over all lines of the text, and a
document's score is their mean weighted by the lines' bytes. Scores are comparable with the share of good
documents, since the field is fitted by likelihood on documents as they occur.

Fitting: lines take the label of their document. It uses a bounded sample of labelled documents, ``FIT_DOCS`` of
them at most, those with the smallest hash of their id among texts of at most ``FIT_LINES`` lines; everything that is
scored is scored whole. Weights are the only thing that is sent to the tasks.

Edge cases: texts without a byte besides line ends (null, empty) get the share of good labels in the sample; with no
labelled rows every score is 0.5; labels other than 0 and 1 are not used for fitting; ids may be null or repeated;
empty tables give no rows. Only the named columns are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .wordhash import SPACED, pieces, words

FIT_DOCS = 4000
FIT_LINES = 400
THRESHOLD = 0.3
STEPS, RATE, DECAY = 160, 0.08, 1e-3

#: Byte classes whose share of a line is a feature.
_CLASSES = [
    range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" \t", b"!", b"#$%&*@^~", b"|<>{}[]\\/=_+`", b".,;:?'\"()-",
    range(0x80, 0x100), [*range(0x00, 0x09), *range(0x0B, 0x20), 0x7F],
]
_LEVELS = np.array([0, .01, .02, .05, .1, .2, .35, .5, .75], np.float32)
_SIZES = np.array([0, 3, 8, 16, 32, 64, 128, 256, 512, 1024], np.float32)
_MEANS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 15], np.float32)
WIDTH = len(_LEVELS) * (len(_CLASSES) + 3) + 2 * len(_SIZES) + len(_MEANS) + 1


class Lines(NamedTuple):
    """Lines of a piece in order: features, bytes, number of lines of each text."""

    x: np.ndarray
    size: np.ndarray
    count: np.ndarray


def describe(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """The lines of the texts of a piece."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a line end at the very end of a text opens an empty line of that text, before the next text begins
    owner = np.searchsorted(offsets, breaks, "right") - 1
    text = np.sort(np.concatenate([np.arange(n), owner]), kind="stable")
    count = np.bincount(text, minlength=n)
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.cumsum(count) - 1
    end[last] = offsets[1:]
    end = np.maximum(end, start)
    size = end - start
    safe = np.maximum(size, 1).astype(np.float32)
    shares = []
    for members in _CLASSES:
        flag = np.zeros(256, bool)
        flag[list(members)] = True
        upto = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flag[data], out=upto[1:])
        shares.append((upto[end] - upto[start]) / safe)
    w = words(data, offsets, SPACED)
    at = offsets[w.text] + w.start
    line = np.searchsorted(start, at, "right") - 1
    n_words = np.bincount(line, minlength=len(start))
    many = np.maximum(n_words, 1).astype(np.float32)
    same = np.zeros(len(line), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((w.hash, line))
    fresh = np.ones(len(line), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(start))
    # words that end in a byte of a symbol class rather than in a letter or plain punctuation
    odd = np.zeros(256, bool)
    odd[list(b"!#$%&*@^~|<>{}[]\\/=_+`")] = True
    ends_odd = np.bincount(line, weights=odd[data[offsets[w.text] + w.end - 1]] if len(line) else None, minlength=len(start))
    shares += [1 - distinct / many, np.bincount(line, weights=same, minlength=len(start)) / many, ends_odd / many]
    mean = np.bincount(line, weights=w.end - w.start, minlength=len(start)) / many
    x = np.concatenate(
        [(s[:, None] > _LEVELS) for s in shares]
        + [size[:, None] > _SIZES, n_words[:, None] > _SIZES, mean[:, None] > _MEANS, np.ones((len(start), 1), bool)], axis=1)
    return Lines(x, size, count)


class Field(NamedTuple):
    """Weights of a line's own features and of its neighbours', of the four steps between states, and the prior."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    prior: float


def _neighbours(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line has one before and after it in its text."""
    total = int(count.sum())
    first = np.zeros(total, bool)
    first[np.cumsum(count) - count] = True
    last = np.zeros(total, bool)
    last[np.cumsum(count) - 1] = True
    return ~first, ~last


def _pull(field: Field, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How much the features of each line speak for good."""
    out = x @ np.stack([field.own, field.before, field.after], axis=1).astype(np.float32)
    has_before, has_after = _neighbours(count)
    u = out[:, 0].astype(np.float64)
    u[1:] += np.where(has_before[1:], out[:-1, 1], 0)
    u[:-1] += np.where(has_after[:-1], out[1:, 2], 0)
    return np.clip(u, -30, 30)


def _walk(u: np.ndarray, count: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward share of good, and backward weights of bad and good, of every line; all texts move together."""
    e, t = np.exp(u), np.exp(step)
    forward, back = np.empty(len(u)), np.full((len(u), 2), 0.5)
    order = np.argsort(-count, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    sizes = count[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    for k, n in enumerate(active):
        at = begin[:n] + k
        good, bad = e[at], np.ones(n)
        if k:
            a = forward[at - 1]
            good, bad = good * (a * t[1, 1] + (1 - a) * t[0, 1]), a * t[1, 0] + (1 - a) * t[0, 0]
        forward[at] = good / (good + bad)
    for k in range(len(active) - 2, -1, -1):
        n = active[k + 1]
        at = begin[:n] + k
        bad, good = back[at + 1, 0], back[at + 1, 1] * e[at + 1]
        to = np.stack([t[0, 0] * bad + t[0, 1] * good, t[1, 0] * bad + t[1, 1] * good], axis=1)
        back[at] = to / to.sum(axis=1, keepdims=True)
    return forward, back, e


def marginals(field: Field, x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability that each line is good."""
    forward, back, _ = _walk(_pull(field, x, count), count, field.step)
    good = forward * back[:, 1]
    return good / (good + (1 - forward) * back[:, 0])


def fit_field(x: np.ndarray, count: np.ndarray, label: np.ndarray) -> Field:
    """Weights of greatest likelihood (with a small penalty) for lines that carry the label of their text."""
    if not len(label):
        return Field(np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.5)
    y = np.repeat(label, count).astype(np.float64)
    has_before, has_after = _neighbours(count)
    xf = x.astype(np.float32)
    pairs = np.flatnonzero(has_after[:-1]) if len(y) > 1 else np.zeros(0, np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pairs].astype(int), y[pairs + 1].astype(int)), 1)
    w = np.zeros(3 * WIDTH + 4)
    mean, var = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, STEPS + 1):
        field = Field(w[:WIDTH], w[WIDTH:2 * WIDTH], w[2 * WIDTH:3 * WIDTH], w[3 * WIDTH:].reshape(2, 2), 0.5)
        forward, back, e = _walk(_pull(field, xf, count), count, field.step)
        good = forward * back[:, 1]
        p = good / (good + (1 - forward) * back[:, 0])
        miss = (y - p).astype(np.float32)
        lead = np.zeros(len(y), np.float32)
        lead[1:] = np.where(has_before[1:], miss[1:], 0)
        follow = np.zeros(len(y), np.float32)
        follow[:-1] = np.where(has_after[:-1], miss[:-1], 0)
        a, b, t = forward[pairs], back[pairs + 1], np.exp(field.step)
        both = np.stack([(1 - a) * t[0, 0] * b[:, 0], (1 - a) * t[0, 1] * b[:, 1] * e[pairs + 1],
                         a * t[1, 0] * b[:, 0], a * t[1, 1] * b[:, 1] * e[pairs + 1]], axis=1)
        steps = seen.ravel() - (both / both.sum(axis=1, keepdims=True)).sum(axis=0)
        # the line before sees the miss of the line after it, and the other way round
        g = np.concatenate([miss @ xf, np.append(lead[1:], 0) @ xf, np.insert(follow[:-1], 0, 0) @ xf, steps])
        g = g / len(y) - DECAY * w
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w = w + RATE * (mean / (1 - 0.9 ** k)) / (np.sqrt(var / (1 - 0.99 ** k)) + 1e-8)
    return Field(w[:WIDTH], w[WIDTH:2 * WIDTH], w[2 * WIDTH:3 * WIDTH], w[3 * WIDTH:].reshape(2, 2), float(label.mean()))


def _sample_rows(batches):
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1)):
            lines = describe(data, offsets)
            ends = np.cumsum(lines.count)
            for i, (a, b) in enumerate(zip(ends - lines.count, ends)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first + i, 1), pa.array([b - a], pa.int32()),
                     pa.array([np.packbits(lines.x[a:b]).tobytes()], pa.binary())], names=["label", "n", "bits"])


def held_out(id_col: str):
    """Rows never learnt from: those whose id, as text, has a crc32 that 5 divides."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on the sample of labelled rows that are not held out."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("label in (0, 1) and id is not null")
    marked = marked.where(~held_out("id")).groupBy("id").agg(F.max("label").cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    # ids of eligible rows first, so that only the texts of the sample are moved
    chosen = (
        texts.where(lines <= FIT_LINES).select("id").join(marked, "id")
        .orderBy(F.xxhash64("id"), "id").limit(FIT_DOCS).collect()
    )
    if not chosen:
        return fit_field(np.zeros((0, WIDTH), bool), np.zeros(0, np.int64), np.zeros(0))
    few = docs.sparkSession.createDataFrame(chosen, marked.schema)
    rows = (
        texts.where(lines <= FIT_LINES).join(F.broadcast(few), "id").select("label", "text")
        .mapInArrow(_sample_rows, "label int, n int, bits binary").toArrow().to_pylist()
    )
    # one order whatever the partitions, so that equal tables give equal weights
    rows.sort(key=lambda r: (r["label"], r["n"], r["bits"]))
    x = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"] * WIDTH).reshape(-1, WIDTH) for r in rows])
    return fit_field(x, np.array([r["n"] for r in rows]), np.array([r["label"] for r in rows], float))


def scores(model: Field, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of lines of each text of a piece."""
    lines = describe(data, offsets)
    good = marginals(model, lines.x.astype(np.float32), lines.count)
    text = np.repeat(np.arange(len(lines.count)), lines.count)
    weight = np.bincount(text, weights=lines.size, minlength=len(lines.count))
    total = np.bincount(text, weights=lines.size * good, minlength=len(lines.count))
    return np.clip(np.where(weight > 0, total / np.maximum(weight, 1), model.prior), 0, 1), lines.count


def _score_rows(field, text_at: int):
    def run(batches):
        model = field.value
        for batch in batches:
            for first, data, offsets in pieces(batch.column(text_at)):
                score, count = scores(model, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, len(score)).columns, pa.array(score), pa.array(count)],
                    names=[f"c{i}" for i in range(batch.num_columns + 2)])
    return run


def with_score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` under the names ``c0``, ``c1``, ..., then the score and the number of lines."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = StructType([*plain.schema.fields, StructField(f"c{len(docs.columns)}", DoubleType()),
                         StructField(f"c{len(docs.columns) + 1}", LongType())])
    held = docs.sparkSession.sparkContext.broadcast(field)
    return plain.mapInArrow(_score_rows(held, docs.columns.index(text_col)), schema)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, n_lines`` of every row."""
    rows = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), field).toDF(
        "doc_id", "text", "score", "n_lines")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines")


def accepted(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected; nothing is shuffled for it."""
    rows = with_score(docs, field, text_col)
    return rows.where(F.col(rows.columns[-2]) >= THRESHOLD).drop(*rows.columns[-2:]).toDF(*docs.columns)
