"""Weighted word shingles of a text as 64-bit hashes, their probability Jaccard similarity, and ProbMinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
MEMORY_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _P
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered; the memory is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def shingle_counts(words: list[bytes], hashes: WordHashes, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs. A text of fewer words is one shingle, one without words none."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out * _P + h[i:i + n])
    unique, counts = np.unique(out, return_counts=True)
    return unique, counts.astype(float)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d); scale of either side doesn't matter."""
    (x, wx), (y, wy) = a, b
    if not len(x) or not len(y):
        return 0.0
    common, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    p, q = wx / wx.sum(), wy / wy.sum()
    only_p, only_q = p.sum() - p[ix].sum(), q.sum() - q[iy].sum()
    p, q = p[ix], q[iy]
    # For d, the elements of larger ratio p/q count with p, the others with q; elements of one side only always do.
    order = np.argsort(-(p / q), kind="stable")
    p, q = p[order], q[order]
    above = np.concatenate([[0.0], np.cumsum(p)[:-1]])
    below = q.sum() - np.concatenate([[0.0], np.cumsum(q)[:-1]])
    return float((1.0 / ((above + only_p) / p + (below + only_q) / q)).sum())


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash (Ertl 2020) of weighted sets: rows x registers of element hashes; rows of empty sets are 0.

    Every element is a Poisson process whose rate is its weight; each arrival picks a register at random, and the
    register keeps the element that arrived first. An element stops once its clock has passed its set's latest register,
    which no later arrival can change, so the result is exact. All elements of all sets step together.
    """
    sizes = np.array([len(s) for s, _ in sets])
    sig = np.zeros(len(sets) * registers, np.uint64)
    if not sizes.sum():
        return sig.reshape(len(sets), registers)
    element = np.concatenate([s for s, _ in sets])
    rate = np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = np.full(len(sets) * registers, np.inf)
    clock, step = np.zeros(len(element)), 0
    while len(element):
        with np.errstate(over="ignore"):
            draw = mix(element ^ mix(np.uint64(2 * step + 1) * np.ones(1, np.uint64)))
            pick = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / rate
        at = owner * registers + (pick % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, clock)
        won = first[at] == clock
        sig[at[won]] = element[won]
        latest = first.reshape(len(sets), registers).max(axis=1)
        going = clock < latest[owner]
        element, rate, owner, clock = element[going], rate[going], owner[going], clock[going]
        step += 1
    return sig.reshape(len(sets), registers)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """Rows x bands: one hash of each band's registers."""
    parts = sig.reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            out = mix(out * _P + parts[:, :, i])
    return out.astype(np.int64)
