"""Whole texts as numpy arrays of UTF-8 bytes: words, lines and their hashes, many texts at once.

Every word pattern used here is a set of single bytes (all non-ASCII bytes on one side), so a
256-entry table says whether a byte belongs to a word and no text has to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes at most, unless one text is longer.
PASS_BYTES = 2 << 20

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_values() -> np.ndarray:
    return mixed(np.arange(256, dtype=np.uint64))


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges, both ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z went to lower case.
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: [^\x20\x09-\x0D]
NOT_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))


class Texts(NamedTuple):
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, bytes) of consecutive rows; null counts as empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PASS_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, Texts(whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


class Spans(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first span of each text, one more than texts


def words_of(texts: Texts, member: np.ndarray) -> Spans:
    """Maximal runs of member bytes, never across two texts."""
    inside = member[texts.data]
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return Spans(empty, empty, np.zeros(len(texts.offsets), np.int64))
    cuts = texts.offsets[:-1]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = texts.offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Spans(starts, ends, np.searchsorted(starts, texts.offsets))


def lines_of(texts: Texts) -> Spans:
    """The pieces between line feeds; a text has one more than line feeds."""
    feeds = np.flatnonzero(texts.data == 10)
    n = len(texts.offsets) - 1
    per = np.searchsorted(feeds, texts.offsets)
    first = per + np.arange(n + 1)
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    heads = first[:-1]
    inner = np.ones(first[-1], bool)
    inner[heads] = False
    starts[heads] = texts.offsets[:-1]
    starts[inner] = feeds + 1
    tails = np.ones(first[-1], bool)
    tails[first[1:] - 1] = False
    ends[first[1:] - 1] = texts.offsets[1:]
    ends[tails] = feeds
    return Spans(starts, ends, first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Spans don't overlap and stand in order."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = lengths > 0
    if full.any():
        n = lengths[full]
        heads = np.cumsum(n) - n
        total = int(heads[-1] + n[-1])
        place = np.arange(total, dtype=np.int64) - np.repeat(heads, n)
        taken = data[place + np.repeat(starts[full], n)]
        out[full] = np.add.reduceat(values[taken] * powers(int(n.max()))[place], heads)
    return mixed(out ^ mixed(lengths.astype(np.uint64)))


def run_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each run hashes[first[i]:first[i + 1]], in order; an empty run hashes as such."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        heads = first[:-1][full]
        lo, hi = int(heads[0]), int(first[1:][full][-1])
        place = np.arange(lo, hi, dtype=np.int64) - np.repeat(heads, n[full])
        out[full] = np.add.reduceat(hashes[lo:hi] * powers(int(n.max()), 0xA0761D6478BD642F)[place], heads - lo)
    return mixed(out ^ mixed(n.astype(np.uint64)))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive ones: one less than len(hashes) - k + 2."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(k, 0xE7037ED1A0B428DB)
    out = hashes[:n] * p[0]
    for j in range(1, k):
        out = out + hashes[j : j + n] * p[j]
    return mixed(out)


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of marks[offsets[i]:offsets[i + 1]]."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
