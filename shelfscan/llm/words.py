"""Vectorised word hashing of Arrow string columns.

Texts stay in their Arrow byte buffer: words are found with a 256-entry
separator table and hashed with a prefix sum of a polynomial over the bytes,
so that no Python object is made per word.  Hashes are 64 bits and the same
in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: ASCII white space: the separators of the n-gram join (fixed values).
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[b for b in range(128) if not chr(b).isalnum()]] = True

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = _RNG.integers(0, 1 << 64, 8, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                      for b in (_BASE, inverse)]
    return _powers


def word_hashes(data: bytes, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the concatenated texts, and each text's first word.

    ``offsets`` holds the start of every text in ``data`` and the end of the
    last one.  Words are the maximal runs of bytes outside ``separators``; the
    letters A-Z count as lower case.  The second array has one entry more than
    there are texts.
    """
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~separators[raw]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | fresh[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | fresh[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _powers_to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return h, np.searchsorted(start, offsets)


def slices(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about a MB."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        yield at, to, (data[lo:hi].to_pybytes() if hi > lo else b""), offsets[at:to + 1] - lo
        at = to


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if len(words) == 0:
        return words
    short = min(size, len(words))
    n = len(words) - short + 1
    h = np.full(n, short if short < size else 0, np.uint64)
    for k in range(short):
        h += words[k:k + n] * _STEP[k % 8] + np.uint64(k)
    return mix64(h)


def distinct_shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct shingles (empty without words)."""
    for at, to, data, offsets in slices(column):
        h, first = word_hashes(data, offsets, SPACES)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(shingle_hashes(h[a:b], size))
