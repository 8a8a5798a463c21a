"""Words and word shingles of a whole Arrow string column, hashed with numpy over its bytes.

A word's hash is a polynomial in a random byte table modulo 2**64, a shingle's a sum of its words' hashes times fixed odd
factors; both are mixed. Two different words or shingles share a hash with a chance of about 2**-64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words: all but blanks, or letters, digits, underscore and all of UTF-8 beyond ASCII.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
WORDLIKE = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (95, 96), (97, 123), (128, 256)):
    WORDLIKE[_a:_b] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[at : at + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, word_bytes: np.ndarray = NOT_BLANK, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the offsets of each row's words, and each word's first byte and end in the column's bytes.
    With `fold`, A to Z count as a to z."""
    data, offsets = column_bytes(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), starts, starts
    stops = np.append(starts[1:], len(data))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, stops - starts)
    powers = np.full(int(at.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    body = data[starts[0] :]
    values = np.where(inside[starts[0] :], _TABLE[_LOWER[body] if fold else body] * powers[at], np.uint64(0))
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    ends = starts + np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of `size` words, in order and with repeats, and the rows' offsets. A row with fewer words
    gives its whole sequence as one shingle; a row without words gives none."""
    counts = np.diff(bounds)
    short = (counts > 0) & (counts < size)
    many = np.where(counts >= size, counts - size + 1, short.astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    total = len(hashes) - size + 1
    if total > 0:
        runs = np.zeros(total, np.uint64)
        for j in range(size):
            runs += hashes[j : j + total] * _FACTORS[j]
        full = np.flatnonzero(counts >= size)
        where = np.repeat(bounds[full] - out_bounds[full], many[full]) + _ranges(out_bounds[full], many[full])
        out[_ranges(out_bounds[full], many[full])] = mix(runs[where])
    for i in np.flatnonzero(short):
        own = hashes[bounds[i] : bounds[i + 1]]
        total = (own * _FACTORS[: len(own)]).sum(keepdims=True, dtype=np.uint64)
        out[out_bounds[i]] = mix(total + _FACTORS[63] * np.array([len(own)], np.uint64))[0]
    return out, out_bounds


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
