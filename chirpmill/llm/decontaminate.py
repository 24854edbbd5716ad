"""Benchmark decontamination by winnowed fingerprints.

Of the hashes of all runs of ``GRAM`` words, winnowing keeps the smallest of every ``WINDOW`` neighbours (the
last of equals). Any span of ``GRAM + WINDOW - 1`` = 10 words that a document shares with a benchmark item is
then sure to share a kept fingerprint, since both sides see the same neighbours. Kept fingerprints of documents
and items are joined, and each hit is extended: the words around it are compared one by one, and every 10-word
window of the item that stands there marks its words as hit. Items of fewer than 10 words are one window; their
fingerprint is the hash of the whole item, looked up among the runs of as many words.

A document sends a fingerprint only if a filter of fixed size (``FILTER_BITS``), made of all item fingerprints,
may hold it, so what is shuffled follows the hits and not the texts. The join itself is left to Spark: item
fingerprints are a written table, broadcast only if its size on disk is below the session's threshold.

Edge cases: a null or wordless text has no words and no hits; an item without words is never found; ids may be
null or repeated (rows with one id share the hits of all of them; an item id names all texts it is given with);
empty tables give zero hits. Only the two named columns of each table are read, so no other column can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpmill.session import stage

from .wordhash import LETTERED, grams, pieces, words

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: Words before and after the start of a fingerprint that any matching window around it can reach.
BEFORE, AFTER = SPAN - GRAM, SPAN - 1
FILTER_BITS = 23

_LONG = pa.list_(pa.int64())
_FOUND = pa.list_(pa.struct([("size", pa.int32()), ("print", pa.int64()), ("pos", pa.int64()), ("near", _LONG)]))
_FOUND_DDL = "array<struct<size:int,print:bigint,pos:bigint,near:array<bigint>>>"


def kept_prints(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes that winnowing keeps: of each ``WINDOW`` neighbours in one text the smallest."""
    g = grams(value, GRAM)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
    best = np.arange(n) + WINDOW - 1 - np.argmin(view, axis=1)
    places = np.unique(best[text[:n] == text[SPAN - 1:SPAN - 1 + n]])
    return places, g[places]


def short_prints(value: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all runs of ``size`` words inside one text."""
    g = grams(value, size, salt=size)
    places = np.flatnonzero(text[:len(g)] == text[size - 1:size - 1 + len(g)])
    return places, g[places]


def _around(value: np.ndarray, text: np.ndarray, places: np.ndarray, absent: int) -> np.ndarray:
    """Hashes of the words around each place; those outside its text get a value that equals no other."""
    at = places[:, None] + np.arange(-BEFORE, AFTER + 1)
    safe = np.clip(at, 0, len(value) - 1)
    near = value[safe].view(np.int64)
    near[(at != safe) | (text[safe] != text[places][:, None])] = absent
    return near


def _slot(prints: np.ndarray) -> np.ndarray:
    return prints >> np.uint64(64 - FILTER_BITS)


def _item_rows(batches):
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1)):
            w = words(data, offsets, LETTERED)
            size = np.bincount(w.text, minlength=len(offsets) - 1)
            long = size[w.text] >= SPAN
            out = []
            if long.any():
                places, prints = kept_prints(w.hash, w.text)
                keep = long[places]
                out.append((np.full(keep.sum(), SPAN), places[keep], prints[keep]))
            for m in np.unique(size[(size > 0) & (size < SPAN)]):
                places, prints = short_prints(w.hash, w.text, int(m))
                keep = size[w.text[places]] == m
                out.append((np.full(keep.sum(), m), places[keep], prints[keep]))
            for sizes, places, prints in out:
                if not len(places):
                    continue
                near = _around(w.hash, w.text, places, -2)
                lists = pa.ListArray.from_arrays(
                    np.arange(len(places) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + w.text[places])), pa.array(sizes, pa.int32()),
                     pa.array(prints.view(np.int64)), pa.array(_slot(prints).astype(np.int64)), lists],
                    names=["item_id", "size", "print", "slot", "item_near"])


def item_prints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, size, print, slot, item_near``: the fingerprints of all items, written once."""
    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()
    return stage(
        source.mapInArrow(_item_rows, f"item_id {kind}, size int, print bigint, slot bigint, item_near array<bigint>"),
        "item-prints")


def _filter(prints: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits that say which fingerprints may be an item's, and the sizes of short items: both of bounded size."""
    cells = (
        prints.groupBy(F.shiftright("slot", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).collect()
    )
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for cell, value in cells:
        bits[cell] = value
    sizes = [r[0] for r in prints.select("size").distinct().collect()]
    return bits, sorted(s for s in sizes if s < SPAN)


def _document_rows(bits, sizes):
    def run(batches):
        table = bits.value.view(np.uint64)
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                n = len(offsets) - 1
                w = words(data, offsets, LETTERED)
                count = np.bincount(w.text, minlength=n)
                begin = np.cumsum(count) - count
                parts = [(SPAN, *kept_prints(w.hash, w.text))] + [(m, *short_prints(w.hash, w.text, m)) for m in sizes]
                size, place, prints = [], [], []
                for m, places, values in parts:
                    slot = _slot(values)
                    may = (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    size.append(np.full(may.sum(), m))
                    place.append(places[may])
                    prints.append(values[may])
                size, place, prints = np.concatenate(size), np.concatenate(place).astype(np.int64), np.concatenate(prints)
                order = np.argsort(w.text[place], kind="stable") if len(place) else place
                size, place, prints = size[order], place[order], prints[order]
                owner = w.text[place]
                near = _around(w.hash, w.text, place, -1) if len(place) else np.zeros((0, 1), np.int64)
                lists = pa.ListArray.from_arrays(
                    np.arange(len(place) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))
                structs = pa.StructArray.from_arrays(
                    [pa.array(size, pa.int32()), pa.array(prints.view(np.int64)), pa.array(place - begin[owner]), lists],
                    fields=list(_FOUND.value_type))
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(edges, structs)],
                    names=["doc_id", "n_words", "found"])
    return run


def scan_documents(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, found``: one row for each document with its fingerprints that may be an item's."""
    bits, sizes = _filter(prints)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 1 MB, whatever the size of the benchmark
    return stage(source.mapInArrow(_document_rows(held, sizes), f"doc_id {kind}, n_words bigint, found {_FOUND_DDL}"),
                 "document-prints")


def spans(scanned: DataFrame, prints: DataFrame) -> DataFrame:
    """``doc_id, item_id, first, size``: every window of an item that stands in a document, from word ``first`` on."""
    found = scanned.where(F.size("found") > 0).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    long = (
        f"transform(filter(sequence(0, {WINDOW - 1}), s -> forall(slice(same, s + 1, {SPAN}), x -> x)),"
        f" s -> cast(s - {BEFORE} as bigint))"
    )
    short = f"if(forall(slice(same, {BEFORE + 1}, size), x -> x), array(0L), cast(array() as array<bigint>))"
    return (
        found.join(prints.drop("slot"), ["size", "print"])
        .withColumn("same", F.expr("zip_with(near, item_near, (a, b) -> a = b)"))
        .select("doc_id", "item_id", "pos", "size", F.explode(F.expr(f"if(size = {SPAN}, {long}, {short})")).alias("shift"))
        .select("doc_id", "item_id", (F.col("pos") + F.col("shift")).alias("first"), "size")
        .distinct()
    )


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row for each document (``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``), and the spans."""
    prints = item_prints(items, item_id, item_text)
    scanned = scan_documents(docs, prints, doc_id, doc_text)
    found = stage(spans(scanned, prints), "item-spans")
    hit = (
        found.select("doc_id", F.explode(F.expr("sequence(first, first + size - 1)")).alias("word")).distinct()
        .groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    )
    named = found.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    both = hit.withColumnRenamed("doc_id", "hit_id").join(named.withColumnRenamed("doc_id", "named_id"),
                                                           F.expr("hit_id <=> named_id")).drop("named_id")
    rows = (
        scanned.select("doc_id", "n_words").join(both, F.expr("doc_id <=> hit_id"), "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
    return rows, found
