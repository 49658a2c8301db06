"""Words of Arrow text columns as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so UTF-8 letters stay whole.
Every function works on a batch of texts at once; batches are cut to a bounded number
of bytes, so memory doesn't depend on how many rows Spark puts into an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2_000_000
_STEP_BYTES = 100_000  # temporaries of this size stay in the CPU's cache
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order; numpy's own way by hashing takes many times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _factors(n: int) -> np.ndarray:
    """An odd factor for each place in a word: powers first, then random ones, for by powers alone
    long words of two letters in regular turns (Thue-Morse, from 1,024 bytes on) would have one hash."""
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    out[_POWERS:] = mix(np.arange(_POWERS, n, dtype=np.uint64) * _GOLD) | np.uint64(1)
    return out


#: A random 64-bit value for every byte; the second table gives A-Z the values of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE, _POWERS = 0xD1342543DE82EF95, 512
_FACTORS = _factors(1 << 12)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch between rows into (rows, bytes, offsets) of about ``most`` bytes; a longer row stays whole."""
    data, offsets = texts_of(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) in bytes of every word, and first[i]: the number of words before row i (n + 1 values).
    ``apart`` tells of every byte whether it parts words."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    space = apart[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | cut[1:-1]
    ends = ~space
    ends[:-1] &= space[1:] | cut[1:-1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes. Spans must be disjoint, in order and not empty."""
    global _FACTORS
    out = np.empty(len(start), np.uint64)
    table, at = _LOWER if lower else _BYTE, 0
    while at < len(start):
        to = min(max(at + 1, int(np.searchsorted(start, start[at] + _STEP_BYTES))), len(start))
        s, e = start[at:to], end[at:to]
        length = (e - s).astype(np.int32)
        if (longest := int(length.max())) > len(_FACTORS):
            _FACTORS = _factors(2 * longest)
        ends = np.cumsum(length, dtype=np.int32)
        first = ends - length
        step = np.zeros(int(e[-1] - s[0]) + 1, np.int8)
        step[s - s[0]] = 1
        step[e - s[0]] -= 1
        value = table[data[s[0] : e[-1]][np.cumsum(step[:-1], dtype=np.int8).view(bool)]]
        value *= _FACTORS[np.arange(ends[-1], dtype=np.int32) - np.repeat(first, length)]
        out[at:to] = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _GOLD)
        at = to
    return out


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` word hashes; runs may cross rows, the caller leaves those out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))):
        out += words[j : j + n] * (c | np.uint64(1))
    return mix(out)


def gram_sets(words: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct gram hashes. A row with fewer words has one gram of all
    its words; a row without words has none."""
    all_grams = grams(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield distinct(all_grams[a : b - size + 1])
        elif b > a:
            yield grams(words[a:b], b - a) + np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)
