"""Queries of fitting, folds and gates (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.core import hash_int
from starfold.operators import fit as X
from starfold.operators import labels as L
from starfold.operators import metrics as M
from starfold.operators import sampling as Q
from starfold.plans import views
from starfold.plans.registry import query


def _features(spark, d):
    """Items with a four-dimensional feature vector and their tier."""
    s = views.with_scores(views.items(spark, d))
    noise = [hash_int(f"f{k}", "id") / float(1 << 32) for k in range(3)]
    x = F.array(F.col("score_b"), F.log1p("value") / 6 + noise[0] * 0.5, noise[1], F.col("score_a") * 0.3 + noise[2])
    return s.withColumn("x", x).withColumn("tier", F.least("star", F.lit(3)))


def _pairs(spark, d):
    return L.label_pairs(views.exam(spark, d), "gid", "id", "user_star", ["event"])


@query("x1_fold_by_event", """SELECT owner, CAST((row_number() OVER (ORDER BY sha256('20260926:' || owner)) - 1) % 3 AS BIGINT) AS fold FROM (SELECT DISTINCT owner FROM items)""")
def x1(spark, d):
    return X.fold_by_event(views.items(spark, d), "owner", 3, "20260926")


@query("x1_fold_balanced", """WITH RECURSIVE u AS (SELECT owner, count(*) AS n FROM items GROUP BY owner), o AS (SELECT owner, n, row_number() OVER (ORDER BY n DESC, {hash:unit:owner}, owner::VARCHAR) AS r FROM u),
  g AS (SELECT 0::BIGINT AS r, [0, 0, 0]::BIGINT[] AS l, 0::BIGINT AS f UNION ALL SELECT o.r, list_transform(g.l, lambda x, i: CASE WHEN i = list_position(g.l, list_min(g.l)) THEN x + o.n ELSE x END), list_position(g.l, list_min(g.l)) - 1 FROM g JOIN o ON o.r = g.r + 1)
  SELECT owner, n AS items, CAST(f AS BIGINT) AS fold FROM o JOIN g USING (r)""")
def x1_balanced(spark, d):
    return X.fold_balanced(views.items(spark, d), "owner", 3, "unit")


@query("x2_fit_four_class")
def x2(spark, d):
    f = _features(spark, d)
    model = X.fit_four_class(f, "event", "x", "tier", 0.01, "event_class")
    p = X.predict_classes(model, f, "x")
    return p.select("id", F.array_position("p", F.array_max("p")).alias("pick"), F.element_at("p", 4).alias("p_top"))


@query("x2_class_weights", """WITH c AS (SELECT event, least(star, 3) AS tier, count(*) AS n FROM items GROUP BY ALL), e AS (SELECT event, sum(n) AS ne, count(*) AS cls FROM c GROUP BY event)
  SELECT event, CAST(tier AS BIGINT) AS tier, round(1.0 / ne / (SELECT count(*) FROM e) * n, 6) AS by_event, round(1.0 / cls / (SELECT count(*) FROM e), 6) AS by_class FROM c JOIN e USING (event)""")
def x2_weights(spark, d):
    i = views.items(spark, d).withColumn("tier", F.least("star", F.lit(3)))
    a = X.class_weights(i, "event", "tier", "event").groupBy("event", "tier").agg(F.sum("weight").alias("by_event"))
    return a.join(X.class_weights(i, "event", "tier", "event_class").groupBy("event", "tier").agg(F.sum("weight").alias("by_class")), ["event", "tier"])


@query("x3_oof_select")
def x3(spark, d):
    f = _features(spark, d)
    folds = X.fold_by_event(f, "event", 3, "20260926")
    oof = X.oof_predict(f, folds, "event", "id", "x", "tier", [0.001, 0.1])
    return X.select_by(X.penalty_report(X.checkpoint(oof), "event", "tier"), ["ap_macro", "balanced_macro", "penalty"])


@query("x4_fit_pairwise")
def x4(spark, d):
    f = _features(spark, d)
    coef = X.fit_pairwise(_pairs(spark, d), f, "id", "x", 0.01, "weight")
    o = M.pair_outcomes(_pairs(spark, d), X.linear_score(f, "x", coef), "id", "score")
    return M.pair_metrics(o, "dstar")


def _constraints(spark, d):
    e = views.exam(spark, d).withColumn("w", F.when(F.col("id") % 3 == 0, 0.3).otherwise(1.0))
    s = views.with_scores(views.shots(spark, d)).withColumn("ret", (F.col("id") % 10 == 0).cast("int")).withColumn("sg", F.concat_ws("/", "event", "owner"))
    c = L.anchor_constraints(e, "gid", "id", "user_star", "w").unionByName(L.flagged_constraints(s, "event", "id", "star", "ret"))
    return c, s


@query("x5_fit_offsets")
def x5(spark, d):
    c, s = _constraints(spark, d)
    b, g, norm = X.fit_offsets(c, s, "id", "star", "sg", "event")
    return X.offset_scores(s, b, g, "star", "sg").groupBy("event", "star").agg(
        F.count(F.lit(1)).alias("items"), F.avg("g").alias("g"), F.avg("b_seg").alias("b_mean"), F.lit(norm).alias("gradient_norm"))


@query("x6_offset_gates")
def x6(spark, d):
    c, s = _constraints(spark, d)
    return X.offset_gates(c, s, "id", "star", "sg", "event")


@query("x7_loeo_pairs")
def x7(spark, d):
    return X.loeo_pairs(_pairs(spark, d), _features(spark, d), "id", "event", "x", 0.01)


@query("x7_loeo_ridge")
def x7_ridge(spark, d):
    return X.loeo_ridge(_features(spark, d), "id", "event", "x", "star")


@query("x8_probe_matrix")
def x8(spark, d):
    f = _features(spark, d).withColumn("x_short", F.slice("x", 1, 2))
    p = _pairs(spark, d).withColumn("layer", F.when(F.col("dstar") >= 2, "far").otherwise("near")).withColumnRenamed("event_winner", "pair_event")
    p = p.join(f.select(F.col("id").alias("winner"), F.col("tier").alias("boundary")), "winner")
    return X.probe_matrix(p, f, "id", {"full": "x", "short": "x_short"}, "layer", X.fold_by_event(f, "event", 3, "20260926"), "event", 0.01, by=["boundary", "pair_event"])


@query("x8_conditioned_features", """SELECT event, count(*) AS items, 20::BIGINT AS width, round(avg(score_b), 6) AS own_mean FROM itemscores GROUP BY event""")
def x8_conditioned(spark, d):
    c = X.conditioned_features(_features(spark, d), "event", "x")
    own = F.aggregate(F.filter("conditioned", lambda v, i: i % 4 == 0), F.lit(0.0), lambda s, v: s + v)
    return c.groupBy("event").agg(F.count(F.lit(1)).alias("items"), F.max(F.size("conditioned")).alias("width"), F.avg(own).alias("own_mean"))


X_SQL = """f AS (SELECT id, event, [score_b, ln(1 + value) / 6 + {hash:f0:id} / 4294967296.0::DOUBLE * 0.5, {hash:f1:id} / 4294967296.0::DOUBLE, score_a * 0.3 + {hash:f2:id} / 4294967296.0::DOUBLE]::DOUBLE[] AS x FROM itemscores)"""


@query("x9_standardise_fit", "WITH " + X_SQL + """, t AS (SELECT k, avg(x[k]) AS m, stddev_samp(x[k]) AS s FROM f, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE event <> 'view' GROUP BY k)
  SELECT id, list(round((x[k] - m) / s, 6) + 0.0 ORDER BY k) AS z FROM f, t GROUP BY id""")
def x9(spark, d):
    z = X.standardise_fit(_features(spark, d), F.col("event") != "view", "x", "z")
    return z.select("id", F.transform("z", lambda v: F.round(v, 6) + F.lit(0.0)).alias("z"))


@query("x9_pca")
def x9_pca(spark, d):
    z = X.standardise_fit(_features(spark, d), F.col("event") != "view", "x", "z", components=2)
    return z.select("id", F.abs(F.col("z")[0]).alias("c0"), F.abs(F.col("z")[1]).alias("c1"))


FUSION_SQL = """WITH lp AS (SELECT a.event, CASE WHEN a.user_star > b.user_star THEN a.id ELSE b.id END AS winner, CASE WHEN a.user_star > b.user_star THEN b.id ELSE a.id END AS loser FROM exam a JOIN exam b ON a.gid = b.gid AND a.id < b.id AND a.user_star <> b.user_star),
  d AS (SELECT lp.event, w.score_a - l.score_a AS a, w.score_b - l.score_b AS b FROM lp JOIN itemscores w ON w.id = winner JOIN itemscores l ON l.id = loser), s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM d),
  m AS (SELECT alpha, event, avg(CASE WHEN a / sa + alpha * b / sb = 0 THEN 0.5 WHEN a / sa + alpha * b / sb > 0 THEN 1.0 ELSE 0.0 END) AS m FROM d, s, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS alpha) GROUP BY ALL)
  SELECT alpha, round(avg(m), 6) AS accuracy FROM m GROUP BY alpha"""


@query("x10_choose_fusion", FUSION_SQL)
def x10(spark, d):
    return X.choose_fusion(_pairs(spark, d), views.with_scores(views.items(spark, d)), "id", "event", "score_a", "score_b", [0.0, 0.5, 1.0, 2.0])


@query("x10_choose_gamma")
def x10_gamma(spark, d):
    i = views.with_scores(views.items(spark, d)).withColumn("tier", F.least("star", F.lit(3)))
    h = F.array(*[hash_int(f"g{k}", "id") % 100 + 1 for k in range(4)])
    i = i.withColumn("h", h).withColumn("p", F.transform("h", lambda v: v / F.aggregate("h", F.lit(0).cast("long"), lambda s, y: s + y)))
    return X.choose_gamma(i, "event", "tier", "p", "score_b", [0.0, 0.5, 1.0])


@query("x11_learning_curve")
def x11(spark, d):
    f = _features(spark, d)
    return X.learning_curve(f, Q.event_subsets(f, "event", [1, 3], 1), "event", "x", "tier", 0.01)


@query("x12_half_transfer")
def x12(spark, d):
    f = _features(spark, d)
    return X.half_transfer(_pairs(spark, d), f, "id", "event", F.concat_ws("/", "event", "owner"), "x", 0.01)


@query("x13_stage_gate")
def x13(spark, d):
    i = X.control_columns(views.items(spark, d).withColumn("tier", F.least("star", F.lit(3))), "id", "tier")
    p = L.label_pairs(views.exam(spark, d), "gid", "id", "star", ["owner"]).withColumnRenamed("owner_winner", "owner")
    acc = lambda s: M.pair_metrics(M.pair_outcomes(p, i, "id", s), "owner").select("owner", "accuracy")
    half = acc("control_noise").withColumn("accuracy", F.lit(0.5))
    out = None
    for name in ("control_noise", "control_truth"):
        value = acc(name).agg(F.avg("accuracy").alias("accuracy"))
        row = value.crossJoin(M.bootstrap_by_event(acc(name), half, "owner", "accuracy", draws=500)).withColumn("arm", F.lit(name))  # one-row frames
        out = row if out is None else out.unionByName(row)
    return X.stage_gate(out, "accuracy", 0.6, 0.52, "low", "high").select("arm", "accuracy", "low", "high", "verdict")
