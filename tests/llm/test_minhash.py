"""Near duplicates against all pairs."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from starfold.llm import minhash
from starfold.llm.shingles import Sketcher, shingle_set, similar


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    group = {}
    for i in range(len(rows)):
        group.setdefault(find(i), []).append(i)
    name = {k: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for k, m in group.items()}
    return sorted(((rows[i][0], len(sets[i]), name[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def corpus(seed, groups=12, copies=25):
    """Groups of texts with edits of every strength, so that a star misses links."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([4, 12, 40, 120]))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, **options).collect()), key=str)


def test_components_equal_all_pairs(spark):
    rows = corpus(5)
    assert found(spark, rows, width=3, percent=85) == brute(rows, 3, 85)


def test_edges(spark):
    text = "One two three four five six"
    rows = [(4, text), (2, text.upper()), (2, text.upper()), (None, text), (7, None), (8, ""), (9, " \n"), (10, "one"), (11, "ONE"), (None, "alone here"), (12, "x " * 30_000)]
    assert found(spark, rows) == brute(rows, 5, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__d", F.lit(1).cast("string")).drop("__d").withColumn("n_shingles", F.lit("mine"))
    kept = minhash.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == 7 and {7, 8, 9, 12} <= set(ids)
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_blocks_give_the_missing_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 4)
    rows = corpus(6, groups=3, copies=40)
    assert found(spark, rows, width=3, percent=85) == brute(rows, 3, 85)


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (1, 5, 50, 200)]
    got = minhash.common_counts(sets, sets[::-1])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]


def test_sketch_estimates_similarity():
    sketcher = Sketcher(51, 5)
    for n, common in ((400, 380), (20, 17), (8, 7)):
        a = [f"a{i}" for i in range(n)]
        b = [*a[:common], *(f"b{i}" for i in range(n - common))]
        x, y = (np.unique(np.array([int(h) for w in s for h in shingle_set(w, 3)], np.uint64)) for s in (a, b))
        sk = sketcher.sketches([x, y])
        assert abs((sk[0] == sk[1]).mean() - common / (2 * n - common)) < 0.12
        assert similar(x, y, 80) == (100 * common >= 80 * (2 * n - common))


def near_copies(n, seed=9):
    """Copies of one text with enough changed words that many pairs are just below or above the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=120)
    rows = []
    for d in range(n):
        own = list(base)
        for _ in range(rng.choice([2, 4, 6, 9])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((d, " ".join(own)))
    return rows


def test_buckets_of_a_centre_are_compared_together(spark):
    members = spark.createDataFrame([(k, 0, n, n, 50) for k in range(20) for n in range(30)] + [(99, 7, 7, 7, 50), (99, 7, 8, 8, 50)], "key long, centre long, node long, comp long, n long")
    rows = minhash.grouped(members).collect()
    assert len(rows) == 30 and {(r["level"], r["gid"], r["blocks"]) for r in rows} == {("root", 0, 1)}


def test_large_buckets_of_a_centre_stay_apart_where_that_sends_less(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SETS", 10)
    members = spark.createDataFrame([(k, 0, 100 * k + n, n, 5) for k in range(20) for n in range(10)], "key long, centre long, node long, comp long, n long")
    rows = minhash.grouped(members).collect()
    assert len(rows) == 200 and {r["gid"] for r in rows} == set(range(20)) and {r["level"] for r in rows} == {"key"}


def test_near_copies_send_few_rows(spark, monkeypatch):
    rows, sent = near_copies(300), []
    whole = minhash.compared

    def watched(members, sets, percent):
        sent.append((minhash.grouped(members).selectExpr("sum(blocks)").first()[0], members.count()))
        return whole(members, sets, percent)

    monkeypatch.setattr(minhash, "compared", watched)
    assert found(spark, rows, width=3, percent=85) == brute(rows, 3, 85)
    assert sent[0][0] <= 4 * len(rows) < sent[0][1] / 2
