"""Periodic runs against a walk over every period."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from starfold.llm import runs


def plain(words):
    """Runs by extending every period at every place."""
    n, seen = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                seen.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in seen.items())


def made(rng):
    kinds, n = rng.choice([1, 2, 3, 10, 500]), rng.choice([0, 1, 5, 6, 7, 20, 60, 200, 400])
    words = [rng.randrange(kinds) for _ in range(n)]
    if rng.random() < 0.7:
        words = []
        while len(words) < n:
            p = rng.choice([1, 2, 3, 5, 14, 30])
            words += ([rng.randrange(kinds) for _ in range(p)] * rng.randint(1, 9))[: rng.randint(1, p * 9)]
    return words[:n]


def test_cover_meets_every_shift():
    for i in range(runs.MODULUS):
        for j in range(runs.MODULUS):
            t = int(runs._shift[i, j])
            assert (i + t) % runs.MODULUS in runs.COVER and (j + t) % runs.MODULUS in runs.COVER


@pytest.mark.parametrize("points", [1, 1 << 20])
def test_runs_equal_a_walk_over_all_periods(monkeypatch, points):
    monkeypatch.setattr(runs, "POINTS", points)
    rng = random.Random(points)
    for _ in range(60 if points > 1 else 6):
        docs = [made(rng) for _ in range(rng.randint(0, 8))]
        got = runs.runs_of([np.array(d, np.int64) for d in docs])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain(d) for d in docs]


def test_cover_order_sorts_suffixes_and_their_common_prefixes():
    rng = np.random.default_rng(4)
    x = np.append(np.tile(rng.integers(0, 3, 37), 9), 99)
    order = runs.CoverOrder(x)
    by_rank = sorted(order.at.tolist(), key=lambda p: x[p:].tolist())
    assert [int(order.at[i]) for i in np.argsort(order.rank)] == by_rank
    i, j = (rng.choice(order.at, 300) for _ in range(2))
    i, j = i[i != j], j[i != j]
    common = lambda a, b: next(t for t in range(len(x)) if max(a, b) + t == len(x) or x[a + t] != x[b + t])
    assert order.common(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def whole(doc_id, text):
    """One document by the definition."""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return doc_id, n, found, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents(spark):
    rng = random.Random(8)
    rows = [(d, rng.choice([" ", "\n", "  "]).join(f"w{k}" for k in made(rng))) for d in range(150)]
    rows += [(None, "a b " * 10), (3, "x " * 3_000), (3, "x " * 3_000), (501, None), (502, ""), (503, " \n"), (504, "é " * 7 + "ü ü ü ü ü ü"), (505, "one two")]
    docs = spark.createDataFrame([(d, t, "mine") for d, t in rows], "doc_id long, text string, runs string")
    got = runs.find_runs(runs.with_periodic_tails(docs)).collect()
    tuples = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"]) for r in got), key=str)
    assert tuples == sorted((whole(d, t) for d, t in rows), key=str)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows)
    assert runs.find_runs(docs.where("false")).count() == 0


def test_very_long_texts():
    words = np.tile(np.arange(700), 60)
    found = runs.runs_of([words, np.zeros(50_000, np.int64)])
    assert found[0].tolist() == [[0, 42_000, 700]] and found[1].tolist() == [[0, 50_000, 1]]
