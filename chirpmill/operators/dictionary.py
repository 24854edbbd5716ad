"""Words and their ids as one constant that every row is looked up in, without a join.

The words are cut into buckets by crc32; a bucket is one short string of ``word<tab>id`` between blanks, and all buckets are
the lines of one text, which Spark splits once into a constant array. A lookup takes the bucket of its word and finds the word
in it. Words of a text hold no white space, so the marks between them cannot be taken for letters.

The constant goes to every task with the plan, so its size is checked: more than ``limit`` words are an error, never a cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import MAX_WORDS, OOV_ID

PER_BUCKET = 4


class Dictionary:
    """Ids of a capped vocabulary."""

    def __init__(self, ids: dict[str, int], limit: int = MAX_WORDS):
        if len(ids) > limit:
            raise ValueError(f"more than {limit} words")
        self.ids = ids
        self.buckets = max(1, len(ids) // PER_BUCKET)
        held: list[list[str]] = [[] for _ in range(self.buckets)]
        for word, n in ids.items():
            if not word or any(c.isspace() for c in word):
                raise ValueError(f"{word!r} is not one word")
            held[zlib.crc32(word.encode()) % self.buckets].append(f"{word}\t{n} ")
        self.text = "\n".join(" " + "".join(h) for h in held)

    @classmethod
    def of(cls, vocabulary: DataFrame, limit: int = MAX_WORDS) -> Dictionary:
        """From a table ``(word, idx)``; at most one row above the limit reaches the driver."""
        return cls({r["word"]: r["idx"] for r in vocabulary.select("word", "idx").limit(limit + 1).collect()}, limit)

    def _found(self, word: Column) -> tuple[Column, Column]:
        place = (F.crc32(word.cast("binary")) % self.buckets).cast("int")
        bucket = F.get(F.split(F.lit(self.text), "\n"), place)
        return bucket, F.call_function("instr", bucket, F.concat(F.lit(" "), word, F.lit("\t")))

    def id_of(self, word: Column, unknown: int = OOV_ID) -> Column:
        bucket, at = self._found(word)
        number = F.substring_index(F.substring(bucket, at + F.char_length(word) + 2, F.lit(20)), " ", 1).cast("int")
        return F.when(at > 0, number).otherwise(unknown)

    def ids_of(self, words: Column, unknown: int = OOV_ID) -> Column:
        """The id of each word of an array; NULL stays NULL."""
        return F.transform(words, lambda w: self.id_of(w, unknown))

    def numbers_of(self, words: Column, unknown: int = OOV_ID) -> Column:
        """What ``ids_of`` gives, by a hash table in each batch of rows: for passes over many long texts."""
        found = self._numbers(unknown)

        def numbered(texts):
            numbers, sizes = found(texts)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), numbers, mask=texts.is_null())

        # the type of its argument is said by name: this module's names are not known where it runs
        numbered.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(numbered, "array<int>")(words)

    def counts_of(self, words: Column, unknown: int) -> Column:
        """How often each id is in an array, as a sparse vector whose last place is ``unknown``: no id is above it.

        Looked up as ``numbers_of`` does and counted where they are found, so that no word goes back to the row.
        """
        found, places = self._numbers(unknown), unknown + 1

        def counted(texts):
            numbers, sizes = found(texts)
            keys = np.repeat(np.arange(len(texts)), sizes) * places + numbers.to_numpy(zero_copy_only=False)
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            ends = pa.array(np.searchsorted(keys[first], np.arange(len(texts) + 1) * places).astype(np.int32))
            times = np.diff(first, append=len(keys)).astype(np.float64)
            return pa.StructArray.from_arrays([
                pa.array(np.zeros(len(texts), np.int8)),
                pa.array(np.full(len(texts), places, np.int32)),
                pa.ListArray.from_arrays(ends, pa.array((keys[first] % places).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(times)),
            ], ["type", "size", "indices", "values"], mask=texts.is_null())

        counted.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(counted, VectorUDT())(words)

    def _numbers(self, unknown: int):
        """The ids of all words of a batch in a row, and how many each text has."""
        listed, numbers = pa.array(list(self.ids), pa.string()), pa.array(list(self.ids.values()), pa.int32())

        def found(texts):
            sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            return pc.fill_null(numbers.take(pc.index_in(texts.flatten(), listed)), unknown), sizes

        return found

    def known_sql(self, words: str, unknown: str) -> str:
        """SQL that keeps the words of an array that have an id and turns the others into ``unknown``."""
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        bucket = f"get(split({quoted(self.text)}, '\\n'), cast(crc32(cast(w as binary)) % {self.buckets} as int))"
        return f"transform({words}, w -> if(instr({bucket}, concat(' ', w, '\\t')) > 0, w, {quoted(unknown)}))"
