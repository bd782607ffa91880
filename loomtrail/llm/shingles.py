"""Word shingles of whole texts as 64-bit hashes, computed over many texts at once with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts (A-Z only), in order, and each text's number of words."""
    raw = [t.encode("utf-8").lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(data))[start]
    limits = np.cumsum([0, *(len(r) + 1 for r in raw)])
    counts = np.diff(np.searchsorted(start, limits + 1))
    return mix(h ^ ((end - start).astype(np.uint64) * _PLACE[63])), counts


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted. Fewer words: the whole sequence as one; no words: empty."""
    with np.errstate(over="ignore"):
        h, counts = word_hashes(texts)
        n = max(0, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for k in range(words):
            s += h[k : k + n] * _PLACE[k]
        s = mix(s)
        at = 0
        for c in counts.tolist():
            if c >= words:
                yield np.unique(s[at : at + c - words + 1])
            elif c:
                yield mix(np.array([sum(int(x) * int(p) for x, p in zip(h[at : at + c], _PLACE, strict=False)) + c & ((1 << 64) - 1)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += c


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
