"""Vectorised text primitives on Arrow buffers.

A batch of texts is one run of UTF-8 bytes plus offsets, so words, word hashes and shingles of a
whole batch come from a few numpy passes and no Python object is made per word.  Words are
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  Batches are cut to ``CHUNK_BYTES`` of text to bound
memory; a single longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, key: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls for ordinary chunk sizes."""
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK_BYTES)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows of at most ``limit`` bytes; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (with a closing entry)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    opens[edges] = solid[edges]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = solid[tails]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: a polynomial prefix sum, rebased to each range's start and mixed."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, "up", len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, "down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


_ROLES = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a run of word hashes (as an array of one), unlike that of any other length."""
    h = len(hashes)
    for i, x in enumerate(hashes):
        h += int(x) * int(_ROLES[i % 64])
    return mix64(np.array([h & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row, text after text, and each text's first one.

    A text of fewer words gives its whole sequence as one; a text without words gives none.
    """
    counts = np.diff(first)
    n = len(hashes)
    full = np.full(max(0, n - size + 1), size, dtype=np.uint64)
    for i in range(size):
        if len(full):
            full += hashes[i : n - size + 1 + i] * _ROLES[i]
    full = mix64(full)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(per, out=bounds[1:])
    source = np.repeat(first[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    short = np.flatnonzero((counts > 0) & (counts < size))
    out = full[np.minimum(source, max(0, len(full) - 1))] if len(full) else np.zeros(bounds[-1], dtype=np.uint64)
    for t in short:
        out[bounds[t]] = sequence_hash(hashes[first[t] : first[t + 1]])[0]
    return out, bounds


def distinct_per_text(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort and de-duplicate each text's values."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    out = np.zeros(len(bounds), dtype=np.int64)
    if parts:
        np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else values[:0]), out


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow list<int64> from flat values."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))
