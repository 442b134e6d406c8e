"""Vectorised hashing of words, word n-grams and weighted elements."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Poisson(1): chance of at most 0, 1, 2, ... darts.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, in which every bit of the input counts."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Words:
    """Hashes of words; those met before are kept, and forgotten when they are many."""

    def __init__(self, most: int = 300_000):
        self.most, self.seen = most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


class Grams:
    """Hashes of every run of k words, from prefix sums of a polynomial."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        if n < k:
            return np.zeros(0, np.uint64)
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, BASE)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, INVERSE)]))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * self.up[:n])])
            return mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1] + np.uint64(k))


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """DartMinHash: ``(owners, k)`` signatures of weighted sets; coordinates agree with the chance of their weighted Jaccard similarity.

    The plane of an element, weight by rank, is cut into unit cells, each with a
    Poisson(1) number of darts that only the element and the cell decide. A set throws
    the darts below its elements' weights and below a rank bound that lets about
    ``k ln k + 2k`` of them through whatever the set's size, and keeps the earliest dart of
    each coordinate. Sets that leave a coordinate empty double their bound. A set of no
    weight gets zeros.
    """
    out = np.zeros((owners, k), np.uint64)
    total = np.bincount(owner, weights, owners)
    with np.errstate(divide="ignore"):
        bound = np.where(total > 0, k * (np.log(k) + 2) / total, 0)
    todo = total > 0
    while todo.any():
        use = todo[owner] & (weights > 0)
        el, w, own = elements[use], weights[use], owner[use]
        deep = np.ceil(bound[own]).astype(np.int64)
        wide = np.ceil(w).astype(np.int64)
        cells = deep * wide
        at = np.repeat(np.arange(len(el)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        across, up = cell // deep[at], cell % deep[at]
        with np.errstate(over="ignore"):
            h = mix(el[at] + mix(across.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + up.astype(np.uint64)))
        count = np.searchsorted(POISSON, (h >> np.uint64(11)) / float(1 << 53), side="right")
        at2 = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(at2)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            dart = mix(h[at2] + (nth.astype(np.uint64) + np.uint64(1)) * BASE)
            place = mix(dart + np.uint64(1))
        rank = up[at2] + (dart >> np.uint64(11)) / float(1 << 53)
        height = across[at2] + (place >> np.uint64(11)) / float(1 << 53)
        who = own[at[at2]]
        hit = (rank < bound[who]) & (height < w[at[at2]])
        who, rank, dart = who[hit], rank[hit], dart[hit]
        spot = who * k + (mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, spot))
        spot, dart = spot[order], dart[order]
        first = np.ones(len(spot), bool)
        first[1:] = spot[1:] != spot[:-1]
        full = np.bincount(spot[first] // k, minlength=owners) == k
        done = todo & full
        keep = first & done[spot // k]
        out.reshape(-1)[spot[keep]] = dart[keep]
        todo &= ~full
        bound = np.where(todo, bound * 2, bound)
    return out


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """``(sets, k)`` MinHash signatures of non-empty sets of hashes: the least value under each of k scrambles."""
    el = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), k), np.uint64)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(k):
            x = el * odd[i]
            x ^= x >> np.uint64(32)
            x *= BASE
            out[:, i] = np.minimum.reduceat(x, starts)
    return out


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """``(sets, bands)`` keys: one for each ``rows`` coordinates, with the band's number hashed in."""
    n, k = signatures.shape
    key = np.zeros((n, k // rows), np.uint64) + np.arange(k // rows, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * BASE + signatures[:, r::rows][:, : k // rows])
    return key.view(np.int64)
