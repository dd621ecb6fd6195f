"""Batched fits against single fits and plain normal equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import batchfit as B
from starfold.operators import fit as X


def table(spark, seed=3, n=600, events=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    event = rng.choice(events, n, p=[0.5, *[0.5 / (events - 1)] * (events - 1)])
    y = np.clip(np.round(x @ [1.0, -0.5, 0.2] + rng.normal(size=n) + 1.5), 0, 3).astype(int)
    rows = [(i, f"e{event[i]}", [float(v) for v in x[i]], int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, event string, x array<double>, tier int"), x, event, y


def test_models_have_zero_gradients_and_do_not_depend_on_each_other(spark):
    d, x, event, y = table(spark)
    rows = d.select("x", F.col("tier").alias("y"), F.lit(1.0).alias("w"), F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("e"), i.cast("string")) != F.col("event")).alias("sets"))
    models = [(s, p) for p in (0.01, 1.0) for s in range(5)] + [(7, 0.1)]
    theta = B.fit_models(rows, models, 3, 4, intercept=True)
    assert np.isnan(theta[-1]).all()  # a set without rows
    z = np.column_stack([x, np.ones(len(x))])
    for (s, p), t in zip(models[:-1], theta, strict=False):
        keep = event != s
        e = np.exp(z[keep] @ t.T)
        g = ((e / e.sum(1, keepdims=True) - np.eye(4)[y[keep]]).T @ z[keep]) / keep.sum() + p * t * [1, 1, 1, 0]
        assert np.abs(g).max() < 1e-8
    alone = B.fit_models(rows, [(2, 0.01)], 3, 4, intercept=True)
    assert np.abs(alone[0] - theta[2]).max() < 1e-6


def test_models_in_several_runs_agree(spark, monkeypatch):
    d = table(spark)[0]
    rows = d.select("x", (F.col("tier") >= 2).cast("int").alias("y"), F.lit(1.0).alias("w"), F.array(F.lit(0), (F.col("id") % 3 + 1).cast("int")).alias("sets"))
    models = [(s, 0.1) for s in range(4)]
    whole = B.fit_models(rows, models, 3)
    monkeypatch.setattr(B, "STATE", 10)
    assert np.abs(B.fit_models(rows, models, 3) - whole).max() < 1e-6


def test_out_of_fold_equals_single_fits(spark):
    d = table(spark)[0]
    folds = X.fold_by_event(d, "event", 2, "s")
    got = {r["id"]: r["p"] for r in X.oof_predict(d, folds, "event", "id", "x", "tier", [0.05], "event_class").collect()}
    j = d.join(folds, "event").cache()
    assert len(got) == 600
    for k in (0, 1):
        model = X.fit_four_class(j.where(F.col("fold") != k), "event", "x", "tier", 0.05, "event_class")
        for r in X.predict_classes(model, j.where(F.col("fold") == k), "x").collect():
            assert np.abs(np.array(r["p"]) - got[r["id"]]).max() < 2e-4  # the single solver stops by its loss
    report = X.penalty_report(X.oof_predict(d, folds, "event", "id", "x", "tier", [0.05, 1.0]), "event", "tier").collect()
    assert len(report) == 2 and all(0 < r[c] <= 1 for r in report for c in ("ap_macro", "ap_macro_2", "ap_macro_1", "balanced_macro"))


def pairs_of(spark, event, y, same):
    rng = np.random.default_rng(5)
    out = set()
    while len(out) < 900:
        i, j = (int(v) for v in rng.integers(len(y), size=2))
        if y[i] > y[j] and (event[i] == event[j] or not same):
            out.add((i, j))
    return sorted(out), spark.createDataFrame(sorted(out), "winner long, loser long")


def test_leave_one_event_out_pairs_equal_single_fits(spark):
    d, x, event, y = table(spark)
    plain, pairs = pairs_of(spark, event, y, False)
    got = {r["event"]: r for r in X.loeo_pairs(pairs, d, "id", "event", "x", 0.01, min_pairs=1).collect()}
    for e in range(5):
        train = [(i, j) for i, j in plain if e not in (event[i], event[j])]
        w = np.array(X.fit_pairwise(spark.createDataFrame(train, "winner long, loser long"), d, "id", "x", 0.01))
        right = [(event[i] == event[j], float((x[i] - x[j]) @ w > 0)) for i, j in plain if e in (event[i], event[j])]
        for name, flag in (("within", True), ("touch", False)):
            part = [v for f, v in right if f == flag]
            assert got[f"e{e}"][f"{name}_pairs"] == len(part)
            assert got[f"e{e}"][name] == pytest.approx(np.mean(part), abs=0.02) if part else got[f"e{e}"][name] is None


def test_ridge_by_subtraction_equals_plain_ridge(spark):
    d, x, event, y = table(spark)
    d = d.unionByName(spark.createDataFrame([(900, "e1", None, 2), (901, None, [1.0, 2.0, 3.0], 1)], d.schema))
    got = {r["event"]: r["coef"] for r in B.loeo_ridge_coefficients(d.repartition(7), "event", "x", "tier", 2.0).collect()}
    for e in range(5):
        a, b = x[event != e], y[event != e].astype(float)
        beta = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + 2.0 * np.eye(3), (a - a.mean(0)).T @ (b - b.mean()))
        assert np.abs(np.array(got[f"e{e}"]) - [b.mean() - a.mean(0) @ beta, *beta]).max() < 1e-9
    one = B.loeo_ridge_coefficients(d.where("event = 'e1'"), "event", "x", "tier").collect()
    assert one == [] and B.loeo_ridge_coefficients(d.limit(0), "event", "x", "tier").collect() == []


def test_half_transfer_learning_curve_and_probes(spark):
    d, _, event, y = table(spark)
    plain, pairs = pairs_of(spark, event, y, True)
    rows = X.half_transfer(pairs, d, "id", "event", F.concat_ws("/", "event", (F.col("id") % 40).cast("string")), "x", 0.01).collect()
    assert rows and all(r["within"] > 0.6 and r["cross"] > 0.6 for r in rows)
    assert X.half_transfer(pairs.limit(0), d, "id", "event", F.col("event"), "x", 0.01).collect() == []
    subsets = spark.createDataFrame([("e0", 1, 0, "e1"), ("e0", 2, 0, "e1"), ("e0", 2, 0, "e2"), ("e1", 1, 0, "e0")], "held_out string, size int, draw int, event string")
    curve = X.learning_curve(d, subsets, "event", "x", "tier", 0.01).collect()
    assert sorted((r["held_out"], r["size"]) for r in curve) == [("e0", 1), ("e0", 2), ("e1", 1)] and all(r["ap"] > r["random_ap"] for r in curve)
    p = pairs.withColumn("layer", F.when(F.col("winner") % 2 == 0, "a").otherwise("b")).withColumn("gap", F.lit("g"))
    folds = X.fold_by_event(d, "event", 2, "s")
    got = X.probe_matrix(p, d, "id", {"v": "x"}, "layer", folds, "event", 0.01, min_test=5, by=["gap"]).collect()
    whole = {(r["layer"], r["split"]): r for r in got if r["arm"] == "all"}
    assert len(whole) == 4 and all(r["mean"] > 0.6 for r in whole.values())
    assert all(r["pairs"] == whole[r["layer"], r["split"]]["pairs"] and r["mean"] == whole[r["layer"], r["split"]]["mean"] for r in got if r["arm"] == "gap")


def test_softmax_evaluates_scores_once_and_curvature_equals_plain_sums(spark):
    rng = np.random.default_rng(4)
    x, coef = rng.normal(size=(6, 3)) * 40, rng.normal(size=(4, 4)) * 9
    d = spark.createDataFrame([([float(v) for v in r], [[float(v) for v in c] for c in coef]) for r in x], "x array<double>, coef array<array<double>>")
    found = d.select(B.softmax(F.col("x"), F.col("coef")).alias("p"))
    z = x @ coef[:, :3].T + coef[:, 3]
    want = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose([r["p"] for r in found.collect()], want / want.sum(axis=1, keepdims=True))
    assert found._jdf.queryExecution().analyzed().toString().lower().count("exp(") == 1
    y, w, theta = rng.integers(0, 3, 6), rng.random((6, 2)), rng.normal(size=(2, 3, 3)) / 9
    sums = B.pass_sums(x / 40, y, w, theta, False)
    p = B.outputs(x / 40, theta, False)[1]
    for m in range(2):
        plain = np.zeros((9, 9))
        for k in range(6):
            q = p[k, m]
            plain += w[k, m] * np.kron(np.diag(q) - np.outer(q, q), np.outer(x[k], x[k]) / 1600)
        assert np.allclose(sums[m, 2 + 9 :].reshape(9, 9), plain)
