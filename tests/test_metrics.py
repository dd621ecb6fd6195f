"""Tie-exact metrics against brute force, floors, ceilings and symmetry."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold import core
from starfold.core import score_position
from starfold.operators import joins as J
from starfold.operators import labels as L
from starfold.operators import metrics as M


def _ap_of_order(labels):
    hits, total = 0, 0.0
    for rank, good in enumerate(labels, 1):
        if good:
            hits += 1
            total += hits / rank
    return total / sum(labels)


def _brute_ap(rows):
    blocks = [list(b) for _, b in itertools.groupby(sorted(rows, key=lambda r: -r[0]), key=lambda r: r[0])]
    orders = itertools.product(*[itertools.permutations([g for _, g in b]) for b in blocks])
    return float(np.mean([_ap_of_order([x for b in o for x in b]) for o in orders]))


def test_ap_equals_average_over_tie_orders(spark):
    rows = [(0.9, 1), (0.5, 0), (0.5, 1), (0.5, 1), (0.2, 0), (0.2, 1), (0.1, 0)]
    d = spark.createDataFrame([("e", s, g) for s, g in rows], "e string, s double, g int")
    r = M.average_precision(d, "e", F.col("g") == 1, "s").first()
    assert math.isclose(r["ap"], _brute_ap(rows), rel_tol=1e-12)
    auc = np.mean([(p > n) + 0.5 * (p == n) for p, g in rows if g for n, h in rows if not h])
    assert math.isclose(r["auc"], auc, rel_tol=1e-12)


@pytest.mark.parametrize("n,good,lead", [(5000, 700, 0), (300, 300, 200), (70, 3, 400), (400, 1, 130)])
def test_long_tie_block_closed_form(spark, n, good, lead):
    rows = [("e", 2.0, i % 2) for i in range(lead)] + [("e", 1.0, int(i < good)) for i in range(n)]
    d = spark.createDataFrame(rows, "e string, s double, g int")
    r = M.average_precision(d, "e", F.col("g") == 1, "s").first()
    h0 = sum(i % 2 for i in range(lead))
    want = sum(good / n * (h0 + 1 + o * (good - 1) / (n - 1)) / (lead + o + 1) for o in range(n))
    first = 0.0 if not lead else sum(h0 / lead * (1 + o * (h0 - 1) / (lead - 1)) / (o + 1) for o in range(lead))
    assert math.isclose(r["ap"], (want + first) / (good + h0), rel_tol=1e-10)


def test_floor_ceiling_and_empty_groups(spark):
    rng = random.Random(1)
    rows = [("a", i, int(rng.random() < 0.3)) for i in range(80)] + [("none", i, 0) for i in range(5)] + [("only", i, 1) for i in range(4)]
    d = spark.createDataFrame(rows, "e string, i int, g int")
    const = {r["e"]: r for r in M.average_precision(d.withColumn("s", F.lit(1.0)), "e", F.col("g") == 1, "s").collect()}
    best = {r["e"]: r for r in M.average_precision(d.withColumn("s", F.col("g").cast("double")), "e", F.col("g") == 1, "s").collect()}
    assert math.isclose(const["a"]["ap"], const["a"]["random_ap"], rel_tol=1e-12) and math.isclose(best["a"]["ap"], 1.0)
    assert const["a"]["auc"] == 0.5 and const["none"]["ap"] is None and const["only"]["auc"] is None and math.isclose(const["only"]["ap"], 1.0)


def test_budget_boundary_is_shared(spark):
    d = spark.createDataFrame([("e", 3.0, 1), ("e", 2.0, 1), ("e", 2.0, 0), ("e", 2.0, 0), ("e", 1.0, 1)], "e string, s double, g int")
    r = M.budget_metrics(d, "e", F.col("g") == 1, "s", [0.5]).first()
    assert r["budget"] == 3 and math.isclose(r["hits"], 1 + 1 * 2 / 3)


def test_pair_accuracy_is_antisymmetric(spark):
    s = spark.createDataFrame([(i, float(i * 7 % 5)) for i in range(20)], "id long, s double")
    p = spark.createDataFrame([(i, (i * 3 + 1) % 20, "e") for i in range(20)], "winner long, loser long, event string").where("winner <> loser")
    a = M.pair_metrics(M.pair_outcomes(p, s, "id", "s"), "event").first()["accuracy"]
    b = M.pair_metrics(M.pair_outcomes(p, s.withColumn("s", -F.col("s")), "id", "s"), "event").first()["accuracy"]
    assert math.isclose(a + b, 1.0)


@pytest.mark.parametrize("scores,good,k", [([3, 2, 2, 1], [1], 2), ([1, 1, 1, 1], [0, 2], 2), ([5, 4, 3], [2], 1), ([2, 2, 1], [0, 1], 1)])
def test_selection_probability(spark, scores, good, k):
    d = spark.createDataFrame([("g", float(s), i in good) for i, s in enumerate(scores)], "gid string, s double, ok boolean")
    got = M.selection_probability(d, "gid", "s", F.col("ok"), k, "p").first()["p"]
    hits, total = 0, 0
    for order in itertools.permutations(range(len(scores))):
        if all(scores[order[i]] >= scores[order[i + 1]] for i in range(len(order) - 1)):
            total += 1
            hits += any(i in good for i in order[:k])
    assert math.isclose(got, hits / total)


def test_required_auc_model(spark):
    d = spark.createDataFrame([(0.05, 0.125), (0.6, 0.125)], "p double, b double")
    a, b = [r[0] for r in d.select(M.required_auc("p", "b")).collect()]
    assert 0.85 < a < 0.97 and b is None


def test_verdicts_conflicts_and_copeland(spark):
    lab = spark.createDataFrame([("w", 1, 3), ("w", 2, 1), ("t", 3, 2), ("t", 4, 2), ("z", 5, 0), ("z", 6, 0)], "gid string, id long, st int")
    assert {r["gid"]: r["status"] for r in L.group_verdict(lab, "gid", "id", "st").collect()} == {"w": "win", "t": "tie", "z": "tie0"}
    p = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "winner long, loser long")
    assert [tuple(r)[:2] for r in L.find_conflicts(p).collect()] == [(1, 2)] and L.quarantine(p).count() == 1
    rounds = spark.createDataFrame([("g", i, r, s) for r, stars in enumerate([(3, 1, 0), (2, 1, 0), (1, 2, 0)]) for i, s in enumerate(stars)], "gid string, id long, rnd int, st int")
    c = {r["id"]: r for r in L.copeland(rounds, "gid", "id", "st", "rnd").collect()}
    assert c[0]["wins"] == 2 and c[0]["is_champion"] == 1 and c[1]["is_top2"] == 1 and c[2]["wins"] == 0


def test_missing_scores_are_refused(spark):
    items = spark.createDataFrame([(1, "a", 1, 0.5), (2, "a", 0, 0.2), (3, "a", 1, None)], "id long, g string, y int, s double")
    nan = items.fillna(float("nan"))
    pairs = spark.createDataFrame([(1, 2), (3, 2)], "winner long, loser long")
    label = F.col("y") == 1
    for df in (items, nan):
        for metric in (lambda d: M.average_precision(d, "g", label, "s"), lambda d: M.budget_metrics(d, "g", label, "s", [0.5]), lambda d: M.rank_sum(d, "g", "id", ["s"])):
            with pytest.raises(Exception, match="missing or non-finite"):
                metric(df).collect()  # already raised when the sorted rows are written
        with pytest.raises(Exception, match="missing or non-finite"):
            M.pair_outcomes(pairs, df, "id", "s").collect()
    with pytest.raises(Exception, match="missing or non-finite"):
        M.pair_outcomes(pairs, items.where("id < 3"), "id", "s").collect()
    assert M.average_precision(items.where("id < 3"), "g", label, "s").first()["ap"] == 1
    one = spark.createDataFrame([("a", 0.5)], "g string, v double")
    two = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "g string, v double")
    with pytest.raises(Exception, match="only on one side"):
        M.bootstrap_by_event(one, two, "g", "v", 10).collect()


def test_required_auc_equals_the_model(spark):
    norm = NormalDist()
    rows = [(r, b) for r in (0.0, 0.05, 0.2, 0.5, 0.9, 1.0) for b in (0.1, 0.25, 0.5, 0.95)]
    got = spark.createDataFrame(rows, "r double, b double").select("r", "b", M.required_auc("r", "b").alias("a")).collect()
    for x in got:
        if x["a"] is None:
            assert x["r"] in (0.0, 1.0) or x["b"] <= 0.8 * x["r"] + 0.01
            continue
        apart = 2**0.5 * norm.inv_cdf(x["a"])
        cut = norm.inv_cdf(1 - (x["b"] - x["r"] * 0.8) / (1 - x["r"])) if x["b"] - x["r"] * 0.8 < 1 - x["r"] else -9
        assert x["a"] == 0.5 or abs(norm.cdf(apart - cut) - 0.8) < 0.01


def test_grouping_column_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.5), (2, "a", 0, 0.2)], "id long, g string, y int, s double").withColumnRenamed("g", "h")
    assert M.average_precision(df, "h", F.col("y") == 1, "s").first()["ap"] == 1


def test_local_summaries_by_event_and_inputs(spark):
    rows = [("a", 1, "e", 5, 0.9), ("a", 2, "e", 3, 0.1), ("b", 1, "e", 4, 0.2), ("b", 3, "e", 1, 0.8), ("b", 4, "e", 0, 0.1), ("c", 5, "f", 2, 0.5), ("d", 6, "f", 0, 0.1), ("d", 7, "f", 0, 0.2), ("g", 8, "f", None, 0.3)]
    d = spark.createDataFrame(rows, "gid string, id long, event string, star int, s double")
    details = M.local_details(d, "gid", "id", "event", "star", "s")
    by = {r["event"]: r for r in M.local_by_event(details).collect()}
    assert (by["e"]["groups"], by["e"]["best1"], by["e"]["best2"], by["e"]["mean_kept2"]) == (2, 0.5, 1.0, 2.0)
    assert by["f"]["groups"] == 1 and by["f"]["mean_kept2"] == 1.0
    whole = {r["scope"]: r for r in M.local_metrics(details).collect()}
    assert whole["unique_best"]["mean_kept2"] == pytest.approx(5 / 3) and whole["member_set_balanced"]["groups"] == 3
    assert tuple(M.local_inputs(d, "gid", "id", "star").first()) == (5, 2, 8, 1)
    assert tuple(M.local_inputs(d.limit(0), "gid", "id", "star").first()) == (0, 0, 0, 0)


def test_group_spearman_leaves_out_groups_of_equal_values(spark):
    rows = [("a", k, k * 0.1) for k in range(5)] + [("b", 3, k * 0.1) for k in range(6)] + [("c", k, 0.5) for k in range(7)] + [("d", 1, 0.1)]
    r = M.group_spearman(spark.createDataFrame(rows, "g string, star int, s double"), "g", "star", "s").first()
    assert r["groups"] == 1 and r["mean"] == pytest.approx(1.0)


def test_carried_events_and_scores_give_the_joined_outcomes(spark):
    items = spark.createDataFrame([(k, "ef"[k % 2], k % 3, [0.1, 0.4, 0.4, 0.9][k % 4]) for k in range(12)], "id long, event string, star int, s double").withColumn("g", F.lit(1))
    carried = J.cross_class_pairs(items, "g", "id", "star", ["event", "s"])
    got = M.pair_metrics(M.add_outcome(M.add_domain(carried, "event_i", "event_j"), "s_i", "s_j"), ["domain", "event_pair"])
    pairs = carried.select(F.col("id_i").alias("winner"), F.col("id_j").alias("loser"))
    want = M.pair_metrics(M.pair_outcomes(M.with_domain(pairs, items, "id", "event"), items, "id", "s"), ["domain", "event_pair"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="missing or non-finite"):
        M.add_outcome(carried.withColumn("s_j", F.lit(None).cast("double")), "s_i", "s_j").collect()


def test_positions_of_positives_from_tie_blocks(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0.1, 0.2, 0.3, i / 1000]), rng.random() < 0.4) for i in range(400)] + [("a", 1000 + i, 5.0, True) for i in range(40)]
    rows += [("none", 2000 + i, 1.0, False) for i in range(3)]
    d = spark.createDataFrame(rows, "e string, id long, s double, l boolean")
    want = score_position(score_position(d, "e", "s", "id", "p").where("l"), "e", "s", "id", "k").select("e", "p", "k")
    want = sorted((str(r["e"]), r["p"], r["k"]) for r in want.collect())
    for block in (10, 100_000):
        got = M.positive_positions(d, "e", F.col("l"), "s", "id", tie_block=block)
        assert sorted((str(r["e"]), r["__pos"], r["__k"]) for r in got.collect()) == want


def test_selector_comparison_sorts_scores_once(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(m, "e", i, rng.randint(0, 5), rng.choice([0.5, i / 50])) for m in ("random", "x") for i in range(50)]
    d = spark.createDataFrame(rows, "method string, event string, id long, star int, score double")
    sorts, whole = [], core.ranged
    monkeypatch.setattr(core, "ranged", lambda *a: sorts.append(1) or whole(*a))
    for legacy in (False, True):
        sorts.clear()
        assert M.selector_comparison(d, "event", "id", "star", legacy=legacy).count() == 2 and len(sorts) == 1


def test_pairs_of_several_ratings_equal_those_of_each(spark):
    labels = spark.createDataFrame([(f"g{i // 4}", i, i * 7 % 3, i * 5 % 4, i % 2) for i in range(40)], "gid string, id long, a int, b int, e int")
    both = L.label_pairs_of(labels, "gid", "id", {"x": "a", "y": "b"}, ["e"])
    one = lambda s: sorted(tuple(r) for r in L.label_pairs(labels, "gid", "id", s, ["e"]).collect())
    for source, star in (("x", "a"), ("y", "b")):
        assert sorted(tuple(r) for r in both.where(F.col("source") == source).drop("source").collect()) == one(star)
    assert both.select("source", "weight", "dstar").count() == len(one("a")) + len(one("b")) > 0


def test_copeland_computes_the_ratings_once(spark):
    rows = [(f"g{i % 9}", i, r, None if (i + r) % 23 == 0 else (i * 7 + r * i) % 5) for i in range(45) for r in range(3) if (i % 9, r) != (4, 2)] + [("g1", 1, 0, 4)]
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    rounds = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), "gid string, id long, rnd int, st int")
    got = {(r["gid"], r["id"]): r for r in L.copeland(rounds, "gid", "id", "st", "rnd").collect()}
    assert set(got) == {(g, i) for g, i, _, _ in rows} and seen.value == len(rows)
    for g in {g for g, *_ in rows}:
        stars = {r: [(i, s) for h, i, q, s in rows if h == g and q == r] for r in range(3)}
        wins = {i: 0 for h, i, _, _ in rows if h == g}
        for i in wins:
            for j in wins:
                votes = [(a > b) - (a < b) for r in stars for k, a in stars[r] if k == i for m, b in stars[r] if m == j and None not in (a, b)]
                wins[i] += votes.count(1) >= 2 and votes.count(1) > votes.count(-1)
        tops = [[s for _, s in v if s is not None] for v in stars.values() if v]
        order = sorted(wins, key=lambda i: (-wins[i], i))
        status = "missing_round" if len(tops) < 3 else "undecided_round" if any(max(t) == 0 or t.count(max(t)) > 1 for t in tops) else "no_champion" if wins[order[0]] == wins[order[1]] else "ok"
        for i in wins:
            row = got[g, i]
            assert (row["wins"], row["status"]) == (wins[i], status) and row["is_champion"] == (status == "ok" and i == order[0])
            assert row["is_top2"] == (status == "ok" and wins[i] >= wins[order[1]])
    assert len({r["status"] for r in got.values()}) > 2
