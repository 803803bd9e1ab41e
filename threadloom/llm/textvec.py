"""Vectorised hashing of words and shingles over the bytes of whole Arrow batches.

A hash of a word is a polynomial over its bytes (each mapped to a random odd 64-bit value)
modulo 2**64, taken from prefix sums and mixed at the end; so a batch of texts is hashed in a
few passes over its bytes, whatever the number of its words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for n places at least; the longest made so far are kept."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        size = 1 << max(n, 2 * CHUNK - 1).bit_length()
        _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS.append(tuple(np.cumprod(np.concatenate([[U(1)], np.full(size, p, dtype=np.uint64)]), dtype=np.uint64) for p in (_P, _P_INV)))
    return _POWERS[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(start, end) row ranges whose texts hold about ``most`` bytes; a longer text comes alone."""
    ends = np.cumsum(np.asarray([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)]))
    i, n = 0, len(ends)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield i, j
        i = j


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, lower-cased in ASCII and separated by one space each, and the place where each starts (and the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return LOWER[data], starts


def words(data: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, in order, between bytes that are gaps; ``data`` ends in one."""
    gap = gaps[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data))
    sums = np.concatenate([[U(0)], np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)])
    return begin, end, mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_ranges(begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of each text's first word (and the end)."""
    return np.searchsorted(begin, starts)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    data, starts = joined(texts)
    begin, _, h = words(data)
    at = word_ranges(begin, starts)
    n = len(h)
    out: list[np.ndarray] = []
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s = mix(s * U(0xC2B2AE3D27D4EB4F) + h[j : n - k + 1 + j])
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one * U(0xC2B2AE3D27D4EB4F) + h[j : j + 1])
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """Bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def release() -> None:
    """Hand freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has the call
        ctypes.CDLL(None).malloc_trim(0)
