"""Queries of ranking and classification metrics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.core import hash_int
from starfold.operators import joins as J
from starfold.operators import labels as L
from starfold.operators import metrics as M
from starfold.plans import views
from starfold.plans.registry import query
from starfold.plans.reports import LP_SQL
from starfold.plans.views import CLUSTER, SEGMENT, table


def _scored(spark, d):
    return views.with_scores(views.items(spark, d))


def _label_pairs(spark, d, cols=()):
    return L.label_pairs(views.exam(spark, d), "gid", "id", "user_star", ["event", *cols])


def _outcomes(spark, d):
    p = _label_pairs(spark, d).withColumnRenamed("event_winner", "event")
    return M.pair_outcomes(p, _scored(spark, d), "id", "score_a")


OUT_SQL = LP_SQL + """, oc AS (SELECT lp.*, CASE WHEN abs(w.score_a - l.score_a) <= 1e-8 THEN 0.5::DOUBLE WHEN w.score_a > l.score_a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome
  FROM lp JOIN itemscores w ON w.id = winner JOIN itemscores l ON l.id = loser)"""
COUNTS = "count(*) AS pairs, count(*) FILTER (outcome = 1) AS correct, count(*) FILTER (outcome = 0) AS wrong, count(*) FILTER (outcome = 0.5) AS ties, round(avg(outcome), 6) AS accuracy"


@query("m1_pair_metrics", f"WITH {OUT_SQL} SELECT event, CAST(dstar AS BIGINT) AS dstar, {COUNTS} FROM oc GROUP BY ALL")
def m1(spark, d):
    return M.pair_metrics(_outcomes(spark, d), ["event", "dstar"])


@query("m1_pair_summary", f"WITH {OUT_SQL} SELECT count(*) AS pairs, count(DISTINCT event) AS events, round(avg(outcome), 6) AS pooled, (SELECT round(avg(m), 6) FROM (SELECT avg(outcome) AS m FROM oc GROUP BY event)) AS event_macro FROM oc")
def m1_summary(spark, d):
    return M.pair_summary(_outcomes(spark, d), "event")


@query("m2_pair_metrics_domains", f"""WITH p AS (SELECT a.id AS winner, b.id AS loser, a.event AS e1, b.event AS e2 FROM items a JOIN items b ON a.owner = b.owner AND a.star > b.star),
  oc AS (SELECT CASE WHEN e1 = e2 THEN 'same_event' ELSE 'cross_event' END AS domain, '["' || least(e1, e2) || '","' || greatest(e1, e2) || '"]' AS event_pair,
    CASE WHEN abs(w.score_a - l.score_a) <= 1e-8 THEN 0.5::DOUBLE WHEN w.score_a > l.score_a THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM p JOIN itemscores w ON w.id = winner JOIN itemscores l ON l.id = loser)
  SELECT domain, event_pair, {COUNTS} FROM oc GROUP BY ALL""")
def m2(spark, d):
    p = J.cross_class_pairs(_scored(spark, d), "owner", "id", "star", ["event", "score_a"])
    o = M.add_outcome(M.add_domain(p, "event_i", "event_j"), "score_a_i", "score_a_j")
    return M.pair_metrics(o, ["domain", "event_pair"])


AP_SQL = """bl AS (SELECT threshold, event, score_a, count(*) AS s, count(*) FILTER (star >= threshold) AS g FROM itemscores, (SELECT unnest(['t1', 't3', 't5']) AS tn, unnest([1, 3, 5]) AS threshold) GROUP BY ALL),
  bc AS (SELECT *, coalesce(sum(s) OVER w, 0)::BIGINT AS a, coalesce(sum(g) OVER w, 0)::BIGINT AS h, sum(s) OVER v AS n, sum(g) OVER v AS p FROM bl WINDOW w AS (PARTITION BY threshold, event ORDER BY score_a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY threshold, event)),
  bx AS (SELECT threshold, event, n, p, a, s, g, h, (SELECT sum(g / s * (h + 1 + CASE WHEN s > 1 THEN o * (g - 1) / (s - 1) ELSE o END) / (a + o + 1)) FROM range(s) r(o)) AS c, g * (n - a - s - (p - h - g) + 0.5 * (s - g)) AS w FROM bc),
  hn AS (SELECT n, sum(1.0 / k) AS hn FROM (SELECT DISTINCT n::BIGINT AS n FROM bc), range(1, 1000000) q(k) WHERE k <= n GROUP BY n),
  ap AS (SELECT 'ge' || threshold AS threshold, event, any_value(n)::BIGINT AS items, any_value(p)::BIGINT AS positives, any_value(p / n) AS prevalence, sum(c) / nullif(any_value(p), 0) AS ap, sum(w) / nullif(any_value(p * (n - p)), 0) AS auc FROM bx GROUP BY ALL),
  ar AS (SELECT ap.*, CASE WHEN positives > 0 THEN (hn + (positives - 1) * (items - hn) / (items - 1)) / items END AS random_ap FROM ap JOIN hn ON hn.n = ap.items)"""


def _per_event(spark, d, ks=(1, 3, 5)):
    return M.average_precision(_scored(spark, d), "event", {f"ge{k}": F.col("star") >= k for k in ks}, "score_a")


@query("m3_average_precision", f"WITH {AP_SQL} SELECT threshold, event, items, positives, round(prevalence, 6) AS prevalence, round(ap, 6) AS ap, round(random_ap, 6) AS random_ap, round(auc, 6) AS auc, round((ap - random_ap) / (1 - random_ap), 6) AS ap_closure FROM ar")
def m3(spark, d):
    return _per_event(spark, d)


@query("m4_ranking_metrics", f"""WITH {AP_SQL} SELECT threshold, count(*) AS events, count(ap) AS events_with_positives, round(avg(ap), 6) AS ap_macro, round(avg(random_ap), 6) AS random_ap_macro, round(avg(prevalence), 6) AS prevalence_macro,
  round(avg(auc), 6) AS auc_macro, round(sum(ap * items) / sum(items), 6) AS ap_item_weighted, round((avg(ap) - avg(random_ap)) / (1 - avg(random_ap)), 6) AS ap_closure FROM ar GROUP BY threshold""")
def m4(spark, d):
    return M.ranking_metrics(_per_event(spark, d))


@query("m25_auc_by_threshold", f"WITH {AP_SQL} SELECT threshold, count(*) AS events, round(sum(auc * items) / sum(items), 6) AS auc FROM ar WHERE auc IS NOT NULL GROUP BY threshold")
def m25(spark, d):
    return M.auc_by_threshold(_per_event(spark, d))


BUD_SQL = """bb AS (SELECT event, fraction, score_a, star, count(*) OVER (PARTITION BY event, fraction) AS n, CAST(ceil(count(*) OVER (PARTITION BY event, fraction) * fraction) AS BIGINT) AS k,
    row_number() OVER (PARTITION BY event, fraction ORDER BY score_a DESC) AS r, count(*) FILTER (star >= 3) OVER (PARTITION BY event, fraction) AS p FROM itemscores, (SELECT unnest([0.125::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE]) AS fraction)),
  be AS (SELECT event, fraction, score_a AS edge FROM bb WHERE r = k),
  bd AS (SELECT bb.event, bb.fraction, any_value(n) AS items, any_value(k) AS budget, any_value(p) AS positives, count(*) FILTER (star >= 3 AND score_a > edge) + count(*) FILTER (star >= 3 AND score_a = edge) * (any_value(k) - count(*) FILTER (score_a > edge)) / count(*) FILTER (score_a = edge) AS hits
    FROM bb JOIN be ON be.event = bb.event AND be.fraction = bb.fraction GROUP BY bb.event, bb.fraction)"""


def _budget(spark, d):
    return M.budget_metrics(_scored(spark, d), "event", F.col("star") >= 3, "score_a", [0.125, 0.25, 0.5])


@query("m5_budget_metrics", f"""WITH {BUD_SQL} SELECT event, fraction, items, budget, positives, round(hits, 6) AS hits, round(hits / budget, 6) AS precision, round(hits / positives, 6) AS recall, round(positives / items, 6) AS random_precision,
  round(budget / items, 6) AS random_recall, round(least(budget, positives) / budget, 6) AS precision_ceiling, round(least(budget, positives) / positives, 6) AS recall_ceiling FROM bd""")
def m5(spark, d):
    return _budget(spark, d)


@query("m6_budget_summary", f"""WITH {BUD_SQL} SELECT fraction, count(*) AS events, round(avg(hits / budget), 6) AS precision_macro, round(avg(hits / positives), 6) AS recall_macro, round(avg(budget / items), 6) AS random_recall_macro,
  round(avg(least(budget, positives) / positives), 6) AS recall_ceiling_macro, round(sum(hits) / sum(budget), 6) AS precision_pooled, round(sum(hits) / sum(positives), 6) AS recall_pooled FROM bd GROUP BY fraction""")
def m6(spark, d):
    return M.budget_summary(_budget(spark, d))


@query("m7_recall_curve", """WITH o AS (SELECT event, star >= 3 AS l, row_number() OVER (PARTITION BY event ORDER BY score_a DESC, {hash:tie:id}, id) AS r, count(*) OVER (PARTITION BY event) AS n, count(*) FILTER (star >= 3) OVER (PARTITION BY event) AS p FROM itemscores),
  h AS (SELECT *, sum(l::INT) OVER (PARTITION BY event ORDER BY r) AS h FROM o), f AS (SELECT event, any_value(n) AS items, any_value(p) AS positives, min(r) AS r FROM h WHERE h >= 0.8 * p GROUP BY event)
  SELECT f.event, items, positives, round(f.r / items, 6) AS list_share, round(h.h / f.r, 6) AS purity FROM f JOIN h ON h.event = f.event AND h.r = f.r""")
def m7(spark, d):
    return M.recall_curve(_scored(spark, d), "event", F.col("star") >= 3, "score_a", "id")


@query("m8_structure_ceiling", "SELECT event, count(*) AS items, count(*) FILTER (star >= 3) AS positives, round(least(1, 0.125 * count(*) / count(*) FILTER (star >= 3)), 6) AS max_recall FROM items GROUP BY event")
def m8(spark, d):
    return M.structure_ceiling(views.items(spark, d), "event", F.col("star") >= 3, 0.125)


def _clusters(spark, d):
    s = views.with_scores(views.shots(spark, d))
    return s.withColumn("cl", F.concat_ws("/", "event", F.col("owner").cast("string"), F.col("cluster").cast("string")))


@query("m9_legacy_cluster_budget", """WITH z AS (SELECT *, event || '/' || owner || '/' || cluster AS cl FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY event, cl ORDER BY score_b DESC, sha256(id::VARCHAR)) AS rr FROM z),
  p AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score_a DESC, sha256(id::VARCHAR)) AS pos FROM r WHERE rr = 1),
  g AS (SELECT event, cl, count(*) AS n, count(*) FILTER (star >= 4) AS p FROM z GROUP BY ALL), t AS (SELECT event, sum(n)::BIGINT AS items, count(*) AS groups, sum(p)::BIGINT AS positive_items, count(*) FILTER (p > 0) AS positive_groups, count(*) FILTER (p > 0 AND n = 1) AS positive_singletons FROM g GROUP BY event),
  f AS (SELECT *, CAST(ceil(items * fraction) AS BIGINT) AS budget FROM t, (SELECT unnest([0.05::DOUBLE, 0.125::DOUBLE]) AS fraction))
  SELECT f.event, fraction, budget, items, groups, positive_items, positive_groups, positive_singletons, count(*) FILTER (pos <= budget) AS kept, count(*) FILTER (pos <= budget AND star >= 4) AS item_hits, count(*) FILTER (pos <= budget AND g.p > 0) AS group_hits,
    count(*) FILTER (pos <= budget AND star >= 4 AND g.n = 1) AS singleton_hits FROM f JOIN p USING (event) JOIN g ON g.event = f.event AND g.cl = p.cl GROUP BY ALL""")
def m9(spark, d):
    return M.legacy_cluster_budget(_clusters(spark, d), "event", "cl", "id", "star", "score_a", "score_b", [0.05, 0.125])


# Selection probability in SQL: products over the boundary block, k <= 2.
LOC_SQL = """lc AS (SELECT e.gid, e.id, e.event, e.user_star, round(s.score_a, 1) AS sc FROM exam e JOIN itemscores s ON s.id = e.id),
  lk AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY user_star DESC, id) AS r, max(user_star) OVER (PARTITION BY gid) AS top FROM lc), ls AS (SELECT *, max(CASE WHEN r = 2 THEN user_star END) OVER (PARTITION BY gid) AS sec FROM lk),
  lx AS (SELECT gid, id, event, top, user_star = top AS best, user_star >= sec AS acc, sc, 0.0::DOUBLE AS z FROM ls WHERE top > 0),
  lq AS (SELECT gid, id, event, q, k, CASE q WHEN 'best1' THEN best WHEN 'best2' THEN best WHEN 'accepted_top2' THEN acc ELSE best END AS ok, CASE WHEN q = 'random_best2' THEN z ELSE sc END AS sc FROM lx, (SELECT unnest(['best1', 'best2', 'accepted_top2', 'random_best2']) AS q, unnest([1, 2, 1, 2]) AS k)),
  lr AS (SELECT *, row_number() OVER (PARTITION BY gid, q ORDER BY sc DESC) AS pos FROM lq), lb AS (SELECT gid, q, sc AS edge FROM lr WHERE pos = k),
  la AS (SELECT lq.gid, lq.q, any_value(k) AS k, count(*) FILTER (sc > edge + 1e-8) AS a, count(*) FILTER (abs(sc - edge) <= 1e-8) AS t, count(*) FILTER (abs(sc - edge) <= 1e-8 AND NOT ok) AS bad, count(*) FILTER (sc > edge + 1e-8 AND ok) AS sure FROM lq JOIN lb ON lb.gid = lq.gid AND lb.q = lq.q GROUP BY lq.gid, lq.q),
  lp2 AS (SELECT gid, q, CASE WHEN sure > 0 THEN 1.0 WHEN bad < k - a THEN 1.0 WHEN k - a = 1 THEN 1 - bad / t ELSE 1 - (bad / t) * ((bad - 1) / nullif(t - 1, 0)) END::DOUBLE AS p FROM la),
  ld AS (SELECT lx.gid, any_value(event) AS event, count(*) AS size, count(*) FILTER (best) = 1 AS unique_best, any_value((SELECT p FROM lp2 WHERE lp2.gid = lx.gid AND q = 'best1')) AS best1, any_value((SELECT p FROM lp2 WHERE lp2.gid = lx.gid AND q = 'best2')) AS best2,
    any_value((SELECT p FROM lp2 WHERE lp2.gid = lx.gid AND q = 'accepted_top2')) AS accepted_top2, any_value((SELECT p FROM lp2 WHERE lp2.gid = lx.gid AND q = 'random_best2')) AS random_best2, count(*) FILTER (best) / count(*) AS random_best1, count(*) FILTER (acc) / count(*) AS random_accepted_top2 FROM lx GROUP BY lx.gid)"""


def _local(spark, d):
    e = views.with_scores(views.exam(spark, d)).withColumn("sc", F.round("score_a", 1))
    return M.local_details(e, "gid", "id", "event", "user_star", "sc")


@query("m10_selection_probability", f"WITH {LOC_SQL} SELECT gid, round(p, 6) AS best2 FROM lp2 WHERE q = 'best2'")
def m10(spark, d):
    e = views.with_scores(views.exam(spark, d)).withColumn("sc", F.round("score_a", 1))
    top = e.groupBy("gid").agg(F.max("user_star").alias("top"))
    e = e.join(top, "gid").where("top > 0")
    return M.selection_probability(e, "gid", "sc", F.col("user_star") == F.col("top"), 2, "best2")


@query("m11_local_details", f"WITH {LOC_SQL} SELECT gid, event, size, unique_best, round(best1, 6) AS best1, round(best2, 6) AS best2, round(accepted_top2, 6) AS accepted_top2, round(random_best1, 6) AS random_best1, round(random_best2, 6) AS random_best2, round(random_accepted_top2, 6) AS random_accepted_top2 FROM ld")
def m11(spark, d):
    return _local(spark, d).drop("members")


AVGS = "round(avg(best1), 6) AS best1, round(avg(best2), 6) AS best2, round(avg(accepted_top2), 6) AS accepted_top2, round(avg(random_best1), 6) AS random_best1, round(avg(random_best2), 6) AS random_best2, round(avg(random_accepted_top2), 6) AS random_accepted_top2"


@query("m11_local_metrics", f"""WITH {LOC_SQL}, sc AS (SELECT *, CASE WHEN unique_best THEN 'unique_best' ELSE 'tied_best' END AS scope FROM ld UNION ALL SELECT *, 'all_nonzero' FROM ld)
  SELECT scope, count(*) AS groups, {AVGS}, round(avg(least(size, 2)), 6) AS mean_kept2, (SELECT round(avg(m), 6) FROM (SELECT avg(best1) AS m FROM sc x WHERE x.scope = sc.scope GROUP BY x.event)) AS best1_event_macro FROM sc GROUP BY scope
  UNION ALL SELECT 'member_set_balanced', count(*), {AVGS}, NULL, NULL FROM ld WHERE unique_best""")
def m11_summary(spark, d):
    return M.local_metrics(_local(spark, d))


@query("m11_local_by_event", f"WITH {LOC_SQL} SELECT event, count(*) AS groups, {AVGS}, round(avg(least(size, 2)), 6) AS mean_kept2 FROM ld WHERE unique_best GROUP BY event")
def m11_by_event(spark, d):
    return M.local_by_event(_local(spark, d))


@query("m11_local_inputs", """SELECT (SELECT count(DISTINCT gid) FROM exam) AS input_groups, (SELECT count(*) FROM (SELECT gid FROM exam GROUP BY gid HAVING max(user_star) <= 0)) AS all_zero_ambiguous,
  count(DISTINCT id) AS unique_items, count(*) - count(DISTINCT id) AS repeated_slots FROM exam""")
def m11_inputs(spark, d):
    return M.local_inputs(views.exam(spark, d), "gid", "id", "user_star")


RANK_SQL = "(rank() OVER (PARTITION BY event ORDER BY {s}) + (count(*) OVER (PARTITION BY event, {s}) - 1) / 2)"


@query("m12_rank_sum", f"SELECT event, id, round({RANK_SQL.format(s='score_a')} + {RANK_SQL.format(s='score_b')}, 6) AS fused FROM itemscores")
def m12(spark, d):
    return M.rank_sum(_scored(spark, d), "event", "id", ["score_a", "score_b"]).select("event", "id", "fused")


@query("m12_weighted_blend", "SELECT event, id, round(0.7 * (score_a - avg(score_a) OVER w) / stddev_pop(score_a) OVER w + 0.3 * (score_b - avg(score_b) OVER w) / stddev_pop(score_b) OVER w, 6) AS fused FROM itemscores WINDOW w AS (PARTITION BY event)")
def m12_blend(spark, d):
    return M.weighted_blend(_scored(spark, d), "event", {"score_a": 0.7, "score_b": 0.3}).select("event", "id", "fused")


@query("m13_greedy_blend")
def m13(spark, d):
    s = _scored(spark, d).withColumn("score_c", hash_int("c", "id") / float(1 << 32))
    return M.greedy_blend(_label_pairs(spark, d), s, "id", ["score_a", "score_b", "score_c"])


@query("m14_conditional_blend", """SELECT e.gid, e.id, round(CASE WHEN {hash:cos:gid} % 100 >= 60 THEN s.score_b ELSE s.score_a END, 6) AS score, CAST({hash:cos:gid} % 100 >= 60 AS BIGINT) AS expert FROM exam e JOIN itemscores s ON s.id = e.id""")
def m14(spark, d):
    e = views.with_scores(views.exam(spark, d)).withColumn("cos", (hash_int("cos", "gid") % 100) / 100.0)
    return M.conditional_blend(e, "score_a", "score_b", "cos", 0.6).select("gid", "id", "score", "expert")


PROB_SQL = """pb AS (SELECT event, least(star, 3) AS truth, [{hash:q0:id} % 100 + CASE WHEN star = 0 THEN 60 ELSE 0 END, {hash:q1:id} % 100, {hash:q2:id} % 100, {hash:q3:id} % 100 + star * 15] AS h FROM items),
  pc AS (SELECT event, truth, list_position(h, list_max(h)) - 1 AS pred FROM pb),
  cf AS (SELECT e.event, t AS truth, q AS pred, count(pc.event) AS n FROM (SELECT DISTINCT event FROM items) e CROSS JOIN range(0, 4) a(t) CROSS JOIN range(0, 4) b(q) LEFT JOIN pc ON pc.event = e.event AND pc.truth = t AND pc.pred = q GROUP BY ALL)"""


def _probs(spark, d):
    i = views.items(spark, d)
    h = [hash_int(f"q{k}", "id") % 100 for k in range(4)]
    h[0] = h[0] + F.when(F.col("star") == 0, 60).otherwise(0)
    h[3] = h[3] + F.col("star") * 15
    i = i.withColumn("h", F.array(*h))
    return i.withColumn("p", F.transform("h", lambda x: x / F.aggregate("h", F.lit(0).cast("long"), lambda s, y: s + y)))


@query("m15_confusion", f"WITH {PROB_SQL} SELECT event, truth, pred, n FROM cf")
def m15(spark, d):
    return M.confusion(_probs(spark, d), "event", F.least("star", F.lit(3)), "p")


@query("m15_classification_metrics", f"""WITH {PROB_SQL}, s AS (SELECT event, sum(n) AS items, {', '.join(f"sum(n) FILTER (truth = {k} AND pred = {k}) AS d{k}, sum(n) FILTER (truth = {k}) AS t{k}, sum(n) FILTER (pred = {k}) AS p{k}" for k in range(4))} FROM (SELECT * FROM cf UNION ALL SELECT 'all', truth, pred, n FROM cf) GROUP BY event)
  SELECT event, CAST(items AS BIGINT) AS items, round((d0 + d1 + d2 + d3) / items, 6) AS accuracy, round((d0 / t0 + d1 / t1 + d2 / t2 + d3 / t3) / 4, 6) AS balanced_accuracy, round(greatest(t0, t1, t2, t3) / items, 6) AS majority_accuracy,
    {', '.join(f"round(d{k} / t{k}, 6) AS recall_{k}, round(d{k} / p{k}, 6) AS precision_{k}" for k in range(4))}, CAST(p3 AS BIGINT) AS selected, CAST(d3 AS BIGINT) AS selected_hits FROM s""")
def m15_metrics(spark, d):
    c = M.confusion(_probs(spark, d), "event", F.least("star", F.lit(3)), "p")
    per = M.classification_metrics(c, "event")
    return per.unionByName(M.classification_metrics(c.withColumn("event", F.lit("all")), "event"))


@query("m16_order_inversion", """WITH x AS (SELECT e.gid, e.id, e.user_star, s.score_a, row_number() OVER (PARTITION BY e.gid ORDER BY e.user_star DESC, e.id) = 1 AS c FROM exam e JOIN itemscores s ON s.id = e.id),
  p AS (SELECT a.gid, abs(a.user_star - b.user_star) AS g, a.c OR b.c AS champ, (a.user_star > b.user_star) <> (a.score_a > b.score_a) AND abs(a.score_a - b.score_a) > 1e-9 AS inv FROM x a JOIN x b ON a.gid = b.gid AND a.id < b.id AND a.user_star <> b.user_star),
  k AS (SELECT gid, inv, CASE WHEN g >= 2 THEN 'hard' ELSE 'soft' END AS kind FROM p UNION ALL SELECT gid, inv, 'champion' FROM p WHERE champ)
  SELECT kind, count(*) AS pairs, count(*) FILTER (inv) AS inversions, count(DISTINCT CASE WHEN inv THEN gid END) AS groups, round(count(*) FILTER (inv) / count(*), 6) AS rate FROM k GROUP BY kind""")
def m16(spark, d):
    return M.order_inversion(views.with_scores(views.exam(spark, d)), "gid", "id", "user_star", "score_a")


@query("m17_exam_profile", """WITH x AS (SELECT e.gid, e.id, e.user_star, s.score_a, CASE WHEN {hash:sig:e.id} % 9 = 0 THEN NULL ELSE ({hash:sig:e.id} % 300) / 100.0::DOUBLE END AS sig FROM exam e JOIN itemscores s ON s.id = e.id),
  g AS (SELECT gid, max(user_star) AS top, list_sort(list(user_star), 'DESC')[2] AS sec, list_sort(list(sig) FILTER (sig IS NOT NULL)) AS v, arg_min(user_star, sig * 100000000 + id) FILTER (sig IS NOT NULL) AS ps, arg_min(user_star, round(-score_a * 200) * 100000000 + id) AS pf, count(*) AS n FROM x GROUP BY gid),
  d AS (SELECT *, coalesce(len(v) >= 2 AND v[2] - v[1] >= gate, false) AS use FROM g, (SELECT unnest([NULL, 0.3::DOUBLE, 1.0::DOUBLE]) AS gate) WHERE top > 0 AND top > sec),
  q AS (SELECT *, CASE WHEN use THEN ps WHEN n >= 2 THEN pf END AS pick FROM d), s AS (SELECT *, 'all' AS slice FROM q UNION ALL SELECT *, CASE WHEN top - sec = 1 THEN 'gap1' ELSE 'gap2+' END FROM q)
  SELECT gate, slice, count(*) AS groups, round(avg((top = pick)::INT), 6) AS exact, round(avg((top - pick <= 1)::INT), 6) AS within1, round(avg((pick >= sec)::INT), 6) AS top_two, round(avg(use::INT), 6) AS signal_share FROM s GROUP BY ALL""")
def m17(spark, d):
    h = hash_int("sig", "id")
    e = views.with_scores(views.exam(spark, d)).withColumn("sig", F.when(h % 9 != 0, (h % 300) / 100.0))
    return M.exam_profile(e, "gid", "id", "user_star", "sig", "score_a", [None, 0.3, 1.0])


@query("m18_win_rate_by_gap", f"""WITH {LP_SQL}, j AS (SELECT weight, w.score_b AS a, l.score_b AS b FROM lp JOIN itemscores w ON w.id = winner JOIN itemscores l ON l.id = loser),
  k AS (SELECT *, CAST(CASE WHEN abs(a - b) < 0.1 THEN 0 WHEN abs(a - b) < 0.25 THEN 1 ELSE 2 END AS BIGINT) AS band FROM j WHERE abs(a - b) < 1)
  SELECT band, count(*) AS pairs, round(sum(weight), 6) AS weight, round(sum(CASE WHEN a < b THEN weight ELSE 0 END) / sum(weight), 6) AS win_rate FROM k GROUP BY band""")
def m18(spark, d):
    return M.win_rate_by_gap(_label_pairs(spark, d), _scored(spark, d), "id", "score_b", [0.0, 0.1, 0.25, 1.0])


TOP1_SQL = """SELECT count(*) AS groups, round(avg((r = mx)::INT), 6) AS top1, round(avg(nt / n), 6) AS chance FROM (SELECT {g}, max(star) AS mx, min(star) AS mn, count(*) AS n, count(*) FILTER (star = m) AS nt, first(star ORDER BY score_a DESC, id) AS r
  FROM (SELECT *, max(star) OVER (PARTITION BY {g}) AS m FROM scored) GROUP BY {g}) WHERE mx - mn >= {k}"""


def _shots(spark, d):
    return views.with_scores(views.clustered(spark, d))


@query("m19_segment_top1", TOP1_SQL.format(g="event, owner, seg", k=1))
def m19(spark, d):
    return M.group_top1(_shots(spark, d), SEGMENT, "id", "star", "score_a")


@query("m19_segment_spearman", """WITH r AS (SELECT event, owner, rank() OVER (PARTITION BY event, owner ORDER BY star) + (count(*) OVER (PARTITION BY event, owner, star) - 1) / 2 AS a, rank() OVER (PARTITION BY event, owner ORDER BY score_a) + (count(*) OVER (PARTITION BY event, owner, score_a) - 1) / 2 AS b FROM itemscores),
  c AS (SELECT corr(a, b) AS c FROM r GROUP BY event, owner HAVING count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b)) SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, count(*) AS groups FROM c""")
def m19_spearman(spark, d):
    return M.group_spearman(_scored(spark, d), ["event", "owner"], "star", "score_a")


RECALL_SQL = """WITH r AS (SELECT star, row_number() OVER (PARTITION BY {g} ORDER BY score_a DESC, {{hash:tie:id}}, id) AS pos, greatest(1, round_even(count(*) OVER (PARTITION BY {g}) * 0.125, 0)) AS q FROM scored {w})
  SELECT count(*) FILTER (pos <= q AND star >= 3) AS hits, count(*) FILTER (star >= 3) AS positives, round(count(*) FILTER (pos <= q AND star >= 3) / count(*) FILTER (star >= 3), 6) AS recall FROM r"""


@query("m19_recall_by_event", RECALL_SQL.format(g="event", w=""))
def m19_recall(spark, d):
    return M.quota_recall(_scored(spark, d), "event", "id", "star", "score_a")


@query("m19_recall_by_segment", RECALL_SQL.format(g="event, owner, seg", w=""))
def m19_seg_recall(spark, d):
    return M.quota_recall(_shots(spark, d), SEGMENT, "id", "star", "score_a")


@query("m20_cluster_top1", TOP1_SQL.format(g="event, owner, cluster", k=2))
def m20(spark, d):
    return M.group_top1(_shots(spark, d), CLUSTER, "id", "star", "score_a", min_gap=2)


@query("m20_top_recall", RECALL_SQL.format(g="event", w="WHERE is_top = 1"))
def m20_recall(spark, d):
    return M.quota_recall(_shots(spark, d).where("is_top = 1"), "event", "id", "star", "score_a")


@query("m21_star_tolerance", """WITH tr AS (SELECT *, row_number() OVER (ORDER BY score_a, id) - 1 AS r, count(*) OVER () AS n FROM splits WHERE split = 'train'),
  q AS (SELECT k, avg((star <= k)::INT) * (any_value(n) - 1) AS x FROM tr, range(0, 5) g(k) GROUP BY k),
  th AS (SELECT q.k, lo.score_a + (hi.score_a - lo.score_a) * (x - floor(x)) AS t FROM q JOIN tr lo ON lo.r = floor(x) JOIN tr hi ON hi.r = ceil(x)),
  e AS (SELECT is_top, abs(count(*) FILTER (s.score_a > th.t) - star) AS e FROM splits s, th WHERE split = 'val' GROUP BY s.id, is_top, star)
  SELECT CASE WHEN is_top = 1 THEN 'clean' ELSE 'ordinary' END AS scope, count(*) AS items, round(avg((e = 0)::INT), 6) AS exact, round(avg((e <= 1)::INT), 6) AS within1, round(avg((e <= 2)::INT), 6) AS within2 FROM e GROUP BY 1""")
def m21(spark, d):
    return M.star_tolerance(views.with_split(_shots(spark, d)), "split", "train", "val", "star", "score_a", "is_top")


@query("m22_band_accuracy", """WITH p AS (SELECT CAST(CASE WHEN cos < 0.2 THEN 0 ELSE 1 END AS BIGINT) AS band, id_i % 6 AS a, id_j % 6 AS b, a.v[1] AS x, b.v[1] AS y FROM vecpairs JOIN vectors a ON a.vec_id = id_i JOIN vectors b ON b.vec_id = id_j WHERE cos >= 0.1)
  SELECT boundary, band, count(*) AS pairs, round(avg(CASE WHEN (a > b) = (x > y) AND x <> y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0.0 END), 6) AS accuracy FROM p, (SELECT unnest([1::BIGINT, 3]) AS boundary) WHERE (a >= boundary) <> (b >= boundary) GROUP BY ALL""")
def m22(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("event"), "embedding", (F.col("vec_id") % 6).alias("star"), F.col("embedding")[0].cast("double").alias("s"))
    return M.band_accuracy(e, "event", "id", "embedding", "star", "s", [0.1, 0.2, 1.01], [1, 3])


@query("m23_bootstrap_by_event", f"""WITH {OUT_SQL}, ob AS (SELECT lp.owner, CASE WHEN abs(w.score_b - l.score_b) <= 1e-8 THEN 0.5::DOUBLE WHEN w.score_b > l.score_b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome FROM lp JOIN itemscores w ON w.id = winner JOIN itemscores l ON l.id = loser),
  df AS (SELECT a.owner, a.m - b.m AS d FROM (SELECT owner, avg(outcome) AS m FROM oc GROUP BY owner) a JOIN (SELECT owner, avg(outcome) AS m FROM ob GROUP BY owner) b USING (owner)),
  n AS (SELECT count(*) AS n FROM df), u AS (SELECT draw, d, ({{hash:boot:owner,draw}} + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM df, range(0, 2000) r(draw)),
  bs AS (SELECT draw, d, {" + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in M.POISSON_STEPS)} AS k FROM u), m AS (SELECT draw, sum(k * d) / sum(k) AS m FROM bs GROUP BY draw HAVING sum(k) > 0)
  SELECT (SELECT n FROM n) AS events, (SELECT round(avg(d), 6) FROM df) AS mean, (SELECT count(*) FROM df WHERE d > 0) AS positive_events, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def m23(spark, d):
    p = _label_pairs(spark, d, ["owner"]).withColumnRenamed("owner_winner", "owner")
    acc = lambda s: M.pair_metrics(M.pair_outcomes(p, _scored(spark, d), "id", s), "owner").select("owner", "accuracy")
    return M.bootstrap_by_event(acc("score_a"), acc("score_b"), "owner", "accuracy", draws=2000)


@query("m24_agreement_two_truths", f"""WITH {OUT_SQL}, x AS (SELECT least(dstar, 3) AS gap, outcome, w.star - l.star AS d FROM oc JOIN items w ON w.id = winner JOIN items l ON l.id = loser)
  SELECT CAST(gap AS BIGINT) AS gap, count(*) AS pairs, round(avg(outcome), 6) AS score_accuracy, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END), 6) AS old_accuracy, round(avg(outcome) FILTER (d <> 0), 6) AS score_accuracy_old_decided FROM x GROUP BY gap""")
def m24(spark, d):
    return M.agreement_two_truths(_label_pairs(spark, d, ["star"]), _scored(spark, d), "id", "score_a", "star")


@query("m26_required_auc")
def m26(spark, d):
    g = views.items(spark, d).groupBy("event").agg(F.avg((F.col("star") >= 3).cast("double")).alias("prevalence"))
    g = J.with_parameters(g, budget=[0.125, 0.25, 0.5])
    return g.select("event", "budget", M.required_auc("prevalence", "budget").alias("required_auc"))


@query("m27_pick_accuracy", """WITH v AS (SELECT gid, CASE WHEN max(user_star) > 0 AND count(*) FILTER (user_star = m) = 1 THEN min(id) FILTER (user_star = m) END AS pick, least(max(star) - min(star), 2) AS bucket FROM (SELECT *, max(user_star) OVER (PARTITION BY gid) AS m FROM exam) GROUP BY gid),
  s AS (SELECT e.gid, e.id, source, CASE source WHEN 'a' THEN score_a ELSE score_b END AS score FROM exam e JOIN itemscores i ON i.id = e.id, (SELECT unnest(['a', 'b']) AS source)),
  t AS (SELECT source, gid, first(id ORDER BY score DESC, id) AS p FROM s GROUP BY ALL), j AS (SELECT source, bucket, p = pick AS ok FROM t JOIN v USING (gid) WHERE pick IS NOT NULL), u AS (SELECT source, ok, 'all' AS stratum FROM j UNION ALL SELECT source, ok, bucket::VARCHAR FROM j)
  SELECT source, stratum, count(*) AS groups, round(avg(ok::INT), 6) AS accuracy FROM u GROUP BY ALL""")
def m27(spark, d):
    e = views.with_scores(views.exam(spark, d))
    s = e.select("gid", "id", F.explode(F.array(F.struct(F.lit("a").alias("source"), F.col("score_a").alias("score")), F.struct(F.lit("b").alias("source"), F.col("score_b").alias("score")))).alias("m")).select("gid", "id", "m.*")
    bucket = e.groupBy("gid").agg(F.least(F.max("star") - F.min("star"), F.lit(2)).alias("bucket"))
    answers = L.group_verdict(e, "gid", "id", "user_star").select("gid", F.col("winner").alias("pick")).join(bucket, "gid")
    return M.pick_accuracy(s, answers, "gid", "id", "bucket")


@query("m28_gap_closure", f"WITH {BUD_SQL} SELECT fraction, count(*) FILTER (ce - fl > 1e-9) AS events, round(avg(CASE WHEN ce - fl > 1e-9 THEN (v - fl) / (ce - fl) END), 6) AS closure FROM (SELECT fraction, hits / positives AS v, budget / items AS fl, least(budget, positives) / positives AS ce FROM bd) GROUP BY fraction")
def m28(spark, d):
    return M.gap_closure(_budget(spark, d), "fraction", "recall", "random_recall", "recall_ceiling")


SELECTOR_SQL = """nz AS (SELECT *, event || '/' || owner || '/' || cluster AS cl, {hash:noise:id} / 8589934592.0::DOUBLE AS nz, (rank() OVER (PARTITION BY event ORDER BY score_a) + (count(*) OVER (PARTITION BY event, score_a) - 1) / 2) + (rank() OVER (PARTITION BY event ORDER BY score_b) + (count(*) OVER (PARTITION BY event, score_b) - 1) / 2) AS fused FROM scored),
  rp AS (SELECT *, row_number() OVER (PARTITION BY event, cl ORDER BY score_a DESC, id) AS r1, max(score_b) OVER (PARTITION BY event, cl) AS gm, row_number() OVER (PARTITION BY event, cl ORDER BY star + nz DESC, id) AS r2 FROM nz),
  lg AS (SELECT method, event, id, star, CASE method WHEN 'random' THEN nz WHEN 'cluster_representative' THEN CASE WHEN r1 = 1 THEN gm + nz * 1e-6 ELSE nz - 1e6 END WHEN 'direct_local' THEN score_a WHEN 'direct_global' THEN score_b WHEN 'rank_sum' THEN fused WHEN 'perfect' THEN star + nz
    ELSE CASE WHEN r2 = 1 THEN star + nz ELSE nz - 1e6 END END AS score FROM rp, (SELECT unnest(['random', 'cluster_representative', 'direct_local', 'direct_global', 'rank_sum', 'perfect', 'one_per_cluster_perfect']) AS method)),
  po AS (SELECT *, row_number() OVER (PARTITION BY method, event ORDER BY score DESC, {hash:tie:id}, id) AS pos, count(*) OVER (PARTITION BY method, event) AS n, count(*) FILTER (star >= 3) OVER (PARTITION BY method, event) AS p FROM lg),
  hh AS (SELECT *, sum((star >= 3)::INT) OVER (PARTITION BY method, event ORDER BY pos) AS h FROM po),
  av AS (SELECT method, event, avg(h / pos) FILTER (star >= 3) AS ap, min(pos) FILTER (h >= 0.8 * p) / any_value(n) AS sh, any_value(p) AS p, any_value(n) AS n FROM hh GROUP BY ALL),
  pu AS (SELECT hh.method, hh.event, h / pos AS pu FROM hh JOIN av ON av.method = hh.method AND av.event = hh.event AND hh.pos = round(av.sh * av.n)),
  bx AS (SELECT method, event, count(*) FILTER (star >= 3 AND pos <= greatest(1, round_even(n * 0.125, 0))) AS k, greatest(1, round_even(any_value(n) * 0.125, 0)) AS q FROM po GROUP BY ALL),
  mm AS (SELECT av.method, count(*) AS events, avg(ap) AS ap, avg(k / q) AS pr, avg(k / p) AS rc, avg(sh) AS sh, avg(pu) AS pu FROM av JOIN bx ON bx.method = av.method AND bx.event = av.event JOIN pu ON pu.method = av.method AND pu.event = av.event GROUP BY av.method)"""


@query("m29_selector_comparison", f"WITH {SELECTOR_SQL}" + """ SELECT method, events, round(ap, 6) AS ap, round(sh, 6) AS share_at_80, round(pu, 6) AS purity_at_80, round((ap - (SELECT ap FROM mm WHERE method = 'random')) / (1 - (SELECT ap FROM mm WHERE method = 'random')), 6) AS closure FROM mm""")
def m29(spark, d):
    long = M.selector_scores(_clusters(spark, d), "event", "cl", "id", "star", "score_a", "score_b")
    return M.selector_comparison(long, "event", "id", "star", legacy=True).select("method", "events", "ap", "share_at_80", "purity_at_80", "closure")


@query("m29_selector_comparison_ties")
def m29_ties(spark, d):
    long = M.selector_scores(_clusters(spark, d), "event", "cl", "id", "star", "score_a", "score_b")
    return M.selector_comparison(long, "event", "id", "star")
