"""Words and word n-grams of many texts at once, as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts in it): text i has the words of offsets[i] to offsets[i + 1]."""
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    white = _WHITE[buf]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    offsets = np.concatenate([[0], np.searchsorted(starts, ends, "right")])
    if not len(starts):
        return np.empty(0, np.uint64), offsets
    stops = np.flatnonzero(~white[:-1] & white[1:]) + 1
    size = stops - starts
    first = np.cumsum(size) - size  # where each word starts among the non-white bytes
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = _BYTE[buf[~white]] * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _STEP), offsets


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, offsets): the sorted set of each text. A text of 1 to n - 1 words has itself as its one n-gram."""
    h, off = words(texts)
    count = np.diff(off)
    wins = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    ends = np.cumsum(wins)
    start = ends - wins
    total = int(wins.sum())
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    doc = np.repeat(np.arange(len(texts)), wins)
    at = np.repeat(off[:-1], wins) + np.arange(total) - start[doc]
    size = np.minimum(count, n)[doc]
    g = np.zeros(total, np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        g += np.where(k < size, padded[at + k] * _PLACE[k], np.uint64(0))
    g = mix(g + size.astype(np.uint64))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(total, bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))])
