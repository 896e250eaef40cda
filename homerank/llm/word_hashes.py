"""Words of whole texts as 64-bit hashes, computed on Arrow's buffers in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a block holds at least before it is handed on; a longer text makes a longer block. Its arrays take some 50 times as much.
BLOCK_BYTES = 250_000
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[list(_SPACES)] = True
    value = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    value[65:91] = value[97:123]  # A-Z count as a-z
    value[space] = 0
    return space, value


_SPACE, _VALUE = _tables()
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, 0xD6E8FEB86659FD93, dtype=np.uint64))])
    return _powers


def block_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data (UTF-8); ends: where each text ends. Second: words of each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = np.concatenate([[0], ends[:-1]])
    inner = firsts[firsts < len(data)]
    begins[inner] |= solid[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        terms = _VALUE[data[starts[0] :]]
        terms *= _power(int(sizes.max()) + 1)[within]
        hashes = mix64(np.add.reduceat(terms, starts - starts[0]))
    upto = np.searchsorted(starts, ends, side="left")
    return hashes, np.diff(np.concatenate([[0], upto]))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, words of each row) for runs of rows of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.string())
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    rows = len(texts)
    if not rows:
        return
    at = np.frombuffer(offsets, wide)[: rows + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = min(max(int(np.searchsorted(at, at[first] + BLOCK_BYTES)), first + 1), rows)
        hashes, counts = block_words(raw[at[first] : at[last]], at[first + 1 : last + 1] - at[first])
        yield first, last - first, hashes, counts
        first = last


def sums_by_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of `counts` values; 0 for empty runs."""
    upto = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(len(counts), dtype=values.dtype)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, upto[:-1][some])
    return out
