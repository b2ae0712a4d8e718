"""Vectorised word and shingle hashing over Arrow string columns.

Works on the UTF-8 bytes of whole texts, a bounded number of bytes at a time
(one very long text is a chunk of its own), so the memory of a task follows its
longest text and never its number of rows.  Only ASCII letters are lower-cased
and both word classes are decided by single bytes, so byte work equals
code-point work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2^64
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: word class of ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: word class of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n, kept between calls."""
    have = len(_powers[0])
    if n > have:
        n = max(n, 2 * have)
        for k, base in enumerate((_P, _PINV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads a hash over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """The words of rows ``lo:hi`` of a column."""

    lo: int
    hi: int
    data: np.ndarray    # the rows' bytes, ASCII letters lower-cased if asked
    start: np.ndarray   # of each word, into data
    end: np.ndarray
    hash: np.ndarray    # uint64
    first: np.ndarray   # hi - lo + 1: row r holds words first[r]:first[r + 1]

    def row(self, r: int) -> slice:
        return slice(self.first[r], self.first[r + 1])


def byte_chunks(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into the bytes) with about ``max_bytes`` each; a null is no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def words(col: pa.Array, word_class: np.ndarray, max_bytes: int = 1 << 20, lower: bool = True) -> Iterator[Words]:
    """The words of every row, lower-cased (unless told otherwise), hashed, chunk by chunk."""
    for lo, hi, raw, offs in byte_chunks(col, max_bytes):
        data = LOWER[raw] if lower else raw
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word_class[data]
        cut = np.zeros(n + 1, bool)
        cut[offs] = True  # a word never goes on into the next row
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        p, inv = _power(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
            h = mix((total[end] - total[start]) * inv[start])
        yield Words(lo, hi, data, start, end, h, np.searchsorted(start, offs))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (rows aren't looked at here)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _Q + h[j:n + j]
    return mix(out)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; fewer words make one shingle, none an empty set."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(h, min(k, len(h))))
