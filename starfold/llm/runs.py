"""Periodic runs of words: every maximal repetition whose length is a multiple of its period, whatever the period.

A run of period ``q`` and length ``4 q`` or more covers two words that are ``q`` apart at some multiple of ``3 q``, so all runs
are met on the harmonic grid of pairs ``(i, i + q)``, about ``n ln(n) / 3`` of them for ``n`` words.  How far the words after
and before such a pair agree is its longest common extension:

* suffixes that start at a difference-cover position (mod 13) are sorted, by prefix doubling in strides of 13; for any two
  positions there is a small shift that brings both to such positions;
* a few words are compared up to that shift; most pairs end there.  The others read the rest as a range minimum over the
  common prefixes of neighbouring sorted suffixes (sparse table).

The order is built only over the documents of a batch that have pairs which reach the shift.  Many documents are
handled as one array of word numbers with a unique number behind each, which no extension passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import bind
from starfold.llm.common import WORD
from starfold.llm.workers import slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
SLICE_BYTES = 1 << 20  # text that is handled as one array; a longer text is an array of its own
POINTS = 1 << 20  # grid pairs held at once

# A perfect difference set, so every shift between two positions mod 13 is met by two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
LEAST = 4  # words compared before a shift is taken
_slot = np.full(MODULUS, -1, np.int64)
_slot[list(COVER)] = range(len(COVER))
_shift = np.array([[next(t for t in range(LEAST, LEAST + MODULUS) if _slot[(i + t) % MODULUS] >= 0 and _slot[(j + t) % MODULUS] >= 0)
                    for j in range(MODULUS)] for i in range(MODULUS)])


def agreeing(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of equal words from ``i`` and ``j`` on, at most ``most`` each; the words compared must exist."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    t = 0
    while len(live):
        live = live[x[i[live] + t] == x[j[live] + t]]
        t += 1
        out[live] = t
        live = live[most[live] > t]
    return out


class CoverOrder:
    """Sorted order of the cover-sampled suffixes of ``x``, with range minima of their common prefixes.

    Any window that matters ends before a number that occurs once, so ranks become unique.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        n = len(x)
        blocks = -(-n // MODULUS)
        at = (np.arange(blocks)[:, None] * MODULUS + np.array(COVER)).ravel()
        at = self.at = at[at < n]
        padded = np.concatenate([x + 1, np.zeros(MODULUS, x.dtype)]).astype(np.int64)  # 0 stands for the words behind the end
        rank, most = self._first(padded, at)
        levels, step = [rank], len(COVER)
        while most < len(at) - 1:  # ranks of twice as many words from pairs of ranks
            behind = np.full(len(at), -1, np.int64)
            if step < len(at):
                behind[:-step] = rank[step:]
            _, rank = np.unique(rank * (most + 2) + behind + 1, return_inverse=True)
            most = int(rank.max())
            levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        order = np.empty(len(at), np.int64)
        order[rank] = np.arange(len(at))
        self._minima(self._neighbours(levels, order[:-1], order[1:]))

    @staticmethod
    def _first(padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks by the first 13 words: as many words as fit are packed into one number at a time."""
        width = int(padded.max()) + 1
        rank, most, t = np.zeros(len(at), np.int64), 0, 0
        while t < MODULUS:
            key, room = rank, (most + 1)
            while t < MODULUS and room * width < 1 << 62:
                key, room, t = key * width + padded[at + t], room * width, t + 1
            _, rank = np.unique(key, return_inverse=True)
            most = int(rank.max(initial=0))
        return rank, most

    def _neighbours(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of pairs of sampled suffixes, down the levels of equal ranks and then word by word."""
        out, last = np.zeros(len(a), np.int64), len(self.at) - 1
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)]
            same &= (a <= last) & (b <= last)
            move = np.where(same, len(COVER) << k, 0)
            a, b, out = a + move, b + move, out + np.where(same, MODULUS << k, 0)
        p, q = self.at[np.minimum(a, last)], self.at[np.minimum(b, last)]
        room = np.where((a <= last) & (b <= last), np.minimum(MODULUS, len(self.x) - np.maximum(p, q)), 0)
        return out + agreeing(self.x, p, q, room)

    def _minima(self, common: np.ndarray) -> None:
        self.table = [common.astype(np.int32)]
        while (1 << len(self.table)) <= len(common):
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at sampled positions ``i`` and ``j``, pair by pair and different in each pair."""
        ranks = [self.rank[p // MODULUS * len(COVER) + _slot[p % MODULUS]] for p in (i, j)]
        lo, hi = np.minimum(*ranks), np.maximum(*ranks)  # the minimum over neighbours lo .. hi - 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.table[k][lo[here]], self.table[k][hi[here] - (1 << int(k))])
        return out


class Extensions:
    """Longest common extensions after pairs of positions of ``x``; documents lie behind each other in it."""

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        self.x, self.starts = x, starts

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that agree before the shift, and whether the shift was reached."""
        most = _shift[i % MODULUS, j % MODULUS]
        out = agreeing(self.x, i, j, most)
        return out, out == most

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole extensions; the order is built over the documents that these pairs are in."""
        doc = np.searchsorted(self.starts, i, "right") - 1
        bounds = np.append(self.starts, len(self.x))
        some, k = np.unique(doc, return_inverse=True)
        sizes = bounds[some + 1] - bounds[some]
        places = np.cumsum(sizes) - sizes
        inside = np.concatenate([self.x[bounds[d] : bounds[d + 1]] for d in some])
        _, inside = np.unique(inside, return_inverse=True)
        move = places[k] - bounds[doc]
        i, j = i + move, j + move
        shift = _shift[i % MODULUS, j % MODULUS]
        out = agreeing(inside, i, j, shift)
        left = np.flatnonzero(out == shift)
        if len(left):
            out[left] += CoverOrder(inside).common(i[left] + shift[left], j[left] + shift[left])
        return out


def grid(starts: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the harmonic grid, as (first position, period), in parts of about ``POINTS``."""
    tops = np.where(sizes >= least, sizes // exponent, 0)
    doc = np.repeat(np.arange(len(sizes)), tops)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(tops) - tops, tops) + 1
    step = (exponent - 1) * period
    count = -(-(sizes[doc] - period) // step)
    ends = np.cumsum(count)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, "right")))
        n = count[at:to]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[doc[at:to]], n) + k * np.repeat(step[at:to], n), np.repeat(period[at:to], n)
        at = to


def runs_of(words: list[np.ndarray], least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """For each document (an array of word numbers from 0 on) its runs: rows of (start, length, period), by start and period."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1 + 1  # a unique number before the first document and behind each
    total = int(sizes.sum()) + len(sizes) + 1
    top = max((int(w.max(initial=-1)) for w in words), default=-1) + 1
    x = np.empty(total, np.int64)
    x[np.append(0, starts + sizes)] = top + np.arange(len(sizes) + 1)
    for w, s in zip(words, starts, strict=True):
        x[s : s + len(w)] = w
    pairs = []
    for i, q in grid(starts, sizes, least, exponent):
        same = x[i] == x[i + q]
        pairs.append((i[same], q[same]))
    i, q = (np.concatenate(c) if pairs else np.empty(0, np.int64) for c in (zip(*pairs, strict=True) if pairs else ((), ())))
    ahead = Extensions(x, starts)
    back = Extensions(x[::-1].copy(), (total - 1 - (starts + sizes - 1))[::-1])  # positions p become total - 1 - p
    after, far_after = ahead.near(i, i + q)
    ri, rj = total - i, total - i - q  # the words before i and i + q
    before, far_before = back.near(ri, rj)
    enough = lambda a, b: (a + b + q >= np.maximum(least, exponent * q))
    whole = far_after | far_before | enough(after, before)
    i, q, after, before, far_after, far_before, ri, rj = (c[whole] for c in (i, q, after, before, far_after, far_before, ri, rj))
    if far_after.any():
        after[far_after] = ahead.far(i[far_after], i[far_after] + q[far_after])
    if far_before.any():
        before[far_before] = back.far(rj[far_before], ri[far_before])
    good = enough(after, before)
    start, length, q = (i - before)[good], (after + before + q)[good], q[good]
    order = np.lexsort((q, length, start))  # the same stretch is met for multiples of its period: the smallest is kept
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[first], length[first], q[first]
    order = np.lexsort((q, start))
    rows = np.column_stack([start, length, q])[order]
    cuts = np.searchsorted(rows[:, 0], starts[1:]) if len(starts) else []
    return [r - [s, 0, 0] for r, s in zip(np.split(rows, cuts), starts, strict=True)] if len(words) else []


def covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def strongest(runs: np.ndarray) -> list[int] | None:
    """The run with the greatest length / period, compared exactly; then the smallest start, then the smallest period."""
    best = None
    for s, n, p in runs.tolist():
        if best is None or n * best[2] > best[1] * p:
            best = [s, n, p]
    return best


class Numbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period: word numbers, by start and period), best, collapsed.

    A run is a stretch of words with smallest period ``q``, of at least ``max(6, 4 q)`` words, that no neighbouring word
    extends.  ``best`` is the run of greatest length / period, null without a run.  ``collapsed`` has the words that no run
    holds after its first period, joined by blanks.  Null and empty texts have no words, no runs and an empty ``collapsed``.
    Whole texts are read; a batch is about a megabyte of text, a longer text is alone and takes some hundred bytes a word.
    Repeated rows and null ids are rows like others.  Columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE_BYTES):
            numbers = Numbers()
            texts = [t.split() for t in part.column("text").to_pylist()]  # bytes: cut at the six ASCII white-space characters
            found = runs_of([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in texts])
            kept = [b" ".join(compress(w, ~covered(len(w), r)) if len(r) else w) for w, r in zip(texts, found, strict=True)]
            struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            as_rows = lambda rows: [dict(zip(("start", "length", "period"), x, strict=True)) for x in rows]
            best = [strongest(r) for r in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.array([as_rows(r.tolist()) for r in found], pa.list_(struct)),
                 pa.array([b and as_rows([b])[0] for b in best], struct), pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "best", "collapsed"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = "struct<start:long,length:long,period:long>"
    found = given.mapInArrow(run, f"doc_id long, n_words long, runs array<{kind}>, best {kind}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where a tenth of the texts repeat a stretch of their words up to the end.

    With ``h = crc32(doc_id)`` and ``g = h // 10`` every word from ``a = g % n`` on becomes word ``a + (i - a) % p`` of the same
    text, ``p = 1 + (n - a) // (3 + g % 8)``; only texts with words and ``h % 10 = 0`` change.  A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        repeated = bind(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(
            words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))
        return F.array_join(repeated, " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    changed = bind(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.col("text")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))
