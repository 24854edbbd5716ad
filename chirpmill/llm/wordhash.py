"""Hashes of words and of runs of words, for a whole Arrow column at a time.

A word is a longest run of word bytes inside one text, lower-cased over A-Z. Texts are worked on as UTF-8
bytes in pieces of a few megabytes that never cut a text, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20

_U = np.uint64
_ONE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public splitmix64 generator: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: A number for each byte at each place of a word, for the first places; those behind are worked out.
PLACES = 64
_AT = mix((np.arange(PLACES * 256, dtype=_U) + _U(1)) * _ONE)

#: Bytes that end a word: ASCII white space, or everything in ASCII but letters and digits.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LETTERED = np.zeros(256, bool)
LETTERED[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Words(NamedTuple):
    """Words of some texts in order: number of the text in the batch, byte start and end in it, hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its texts) for pieces of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """The words of a piece."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    begins[edges] = inside[edges]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    ends[edges[edges > 0]] |= inside[edges[edges > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    # the sum of a number for each (place in the word, byte): two words agree by chance alone, whatever they look like
    inner = np.flatnonzero(inside)
    size = end - start
    key = ((inner - np.repeat(start, size)) << 8) + _LOWER[data[inner]]
    near = key < len(_AT)
    part = _AT[np.where(near, key, 0)]
    if not near.all():
        far = np.flatnonzero(~near)
        part[far] = mix((key[far].astype(_U) + _U(1)) * _ONE)
    total = np.zeros(len(inner) + 1, _U)
    np.cumsum(part, out=total[1:])
    last = np.cumsum(size)
    value = mix(total[last] - total[last - size] + size.astype(_U))
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(text, start - offsets[text], end - offsets[text], value)


def grams(value: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring hashes; runs over the edge of a text are for the caller to leave out."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, (salt * 0x632BE59BD9B4E019 + k) & (2**64 - 1), _U)
    for j in range(k):
        out = (out ^ value[j:j + n]) * _ONE
        out ^= out >> _U(32)
    return mix(out)
