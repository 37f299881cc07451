"""Word shingles of whole texts as 64-bit hashes, computed for a batch at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from careflow.llm.common import mix64, text_bytes

WORDS = 5
_KEPT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _random_words(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1))


_BYTE = _random_words(256, 7)
_PLACE = _random_words(64, 11) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse; a worker keeps those of short texts."""
    if n <= _KEPT:
        return tuple(p[:n] for p in _short_powers())
    return _powers(n)


@lru_cache(maxsize=1)
def _short_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_KEPT)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    with np.errstate(over="ignore"):
        out = []
        for b in (base, inverse):
            p = np.full(n, b, np.uint64)
            p[:1] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes of bytes (or of 64-bit values), and the factors that place
    spans alike: (sums[b] - sums[a]) * factors[a] is a value of those from a to b alone."""
    n = len(raw)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_BYTE[raw] if raw.dtype == np.uint8 else raw) * up[:n], out=sums[1:])
    return sums, down


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch in order, and each row's first word (n + 1)."""
    raw, rows = text_bytes(column)
    n = len(raw)
    solid = np.ones(n + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~_BLANK[raw]
    begin = solid[1:-1] & ~solid[:-2]
    end = solid[1:-1] & ~solid[2:]
    inner = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < n)]
    begin[inner] = solid[1:-1][inner]          # a row's first byte begins a word
    end[inner - 1] = solid[1:-1][inner - 1]    # and its last byte ends one
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total, down = prefix_sums(_LOWER[raw])
    with np.errstate(over="ignore"):
        hashes = mix64((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _ODD)
    return hashes, np.searchsorted(start, rows)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Each row's distinct shingles, sorted. Fewer words: all of them as one; no word: none."""
    hashes, first = word_hashes(column)
    with np.errstate(over="ignore"):
        m = max(len(hashes) - words + 1, 0)
        runs = np.zeros(m, np.uint64)
        for k in range(words):
            runs += hashes[k:k + m] * _PLACE[k]
        runs = mix64(runs + np.uint64(words))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(runs[a:b - words + 1]))
            elif b > a:
                whole = (hashes[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix64(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
