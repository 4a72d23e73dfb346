"""Whole texts as byte arrays: words, their hashes and their documents, for a batch at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together; a longer text makes a chunk of its own.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a copy."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            out, have = np.empty(size, np.uint64), 1
            out[0] = 1
            while have < size:
                step = np.uint64(pow(base, have, 1 << 64))
                take = min(have, size - have)
                np.multiply(out[:take], step, out=out[have : have + take])
                have += take
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def byte_table(separators) -> np.ndarray:
    """True for the bytes of words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z; a byte over 0x7F belongs to a character over U+007F.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: ``[^\x20\x09-\x0D]``
NONSPACE = byte_table([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


#: The low bytes of a lane that belong to a word of so many bytes.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes from which on a word is hashed by the library.
_LONG = 128


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each range of bytes: lanes of eight bytes, each mixed into all before it.

    The first lane and the length alone tell words of up to eight bytes apart. No power series is summed, so texts made
    to collide in one (words of equal length after the Thue-Morse sequence) don't collide here.
    """
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = end - start
    h = mix((lanes[start] & _MASKS[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64) * _ODD))
    left, at = np.flatnonzero((size > 8) & (size < _LONG)), 8
    while len(left):
        h[left] = mix((h[left] ^ mix((lanes[start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]) + np.uint64(at))) * _ODD)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size >= _LONG).tolist():
        h[k] = np.frombuffer(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


class Words:
    """The words of the texts of a chunk.

    start and end are byte positions, first is the number of the first word of each text (and the total at the end),
    hash has 64 bits for each word, from its lower-cased bytes. Hashes find things; what rests on them is compared again
    by the words themselves.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = offsets[1:] > offsets[:-1]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        begins[heads], ends[tails] = inside[heads], inside[tails]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = word_hashes(LOWER[data], self.start, self.end)

    def document(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text) of all runs of so many words; a text of fewer, but not none, has one of all its words."""
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate(([0], np.cumsum(count)))
    h = words.hash
    total = len(h)
    rolled = np.zeros(max(total, 1), np.uint64)
    for k in range(size):
        rolled[: max(total - k, 0)] += h[k:] * np.uint64(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
    at = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(words.first[:-1], count)
    out = rolled[at]
    for row in np.flatnonzero((n > 0) & (n < size)):
        with np.errstate(over="ignore"):
            value = np.uint64(n[row])
            for k, x in enumerate(h[words.first[row] : words.first[row + 1]]):
                value += x * np.uint64(pow(0xB5297A4D3F84D5B5, k + 1, 1 << 64))
        out[first[row]] = value
    return mix(out), first
