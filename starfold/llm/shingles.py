"""Word-shingle sets and one-permutation sketches, computed inside tasks on whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from starfold.llm.workers import hold

# Upper-case ASCII letters become lower-case ones; bytes.split() cuts at exactly the six ASCII white-space characters.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

CACHE_WORDS = 400_000  # distinct words whose hashes a worker keeps
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hash of each word, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def hold_words() -> None:
    """Keep the hashes of words in this worker, and nothing of other operators."""
    hold("word hashes", _words.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; fewer words make one run, none make none."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = mixed(acc * _MIX[k % 3] + h[k : k + n])
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|; two empty sets are not similar."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    if n > m:
        a, b, n, m = b, a, m, n
    at = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(at, m - 1)] == a))
    return 100 * common >= percent * (n + m - common)


class Sketcher:
    """One-permutation sketches with optimal densification and their band keys.

    The hash range is cut into ``bands * rows`` bins and each bin keeps its smallest hash.  An empty bin copies a full one
    that its own fixed random order of the bins meets first, so any two sets that agree on the full bins agree on it.
    """

    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.probe = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def sketches(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of bin values per set; rows of empty sets are 0."""
        out = np.zeros((len(sets), self.bins), np.uint64)
        full = np.zeros((len(sets), self.bins), bool)
        for i, s in enumerate(sets):
            if len(s):
                at = ((s >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                out[i, at[first]] = s[first]
                full[i, at[first]] = True
        todo = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
        own, had, done = out[todo], full[todo], full[todo]
        for k in range(self.bins):
            if not len(todo):
                break
            source = self.probe[:, k]
            take = had[:, source] & ~done
            out[todo] = own = np.where(take, own[:, source], own)
            done = done | take
            left = ~done.all(axis=1)
            if not left.all():
                todo, own, had, done = todo[left], own[left], had[left], done[left]
        return out

    def keys(self, sketches: np.ndarray) -> np.ndarray:
        """One signed 64-bit key per row and band."""
        cells = sketches.reshape(len(sketches), self.bands, self.rows)
        acc = np.broadcast_to(self.salt, (len(sketches), self.bands)).copy()
        for k in range(self.rows):
            acc = mixed(acc * _MIX[0] + cells[:, :, k])
        return acc.view(np.int64)
