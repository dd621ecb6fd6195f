"""Queries of aggregations (A) and label handling (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.core import hash_int, written
from starfold.functions import vectors as V
from starfold.operators import labels as L
from starfold.operators import pairs as P
from starfold.operators import segments as T
from starfold.operators import summary as A
from starfold.plans import views
from starfold.plans.registry import query
from starfold.plans.views import CLUSTER, SEGMENT, table

FILES_SQL = """files AS (SELECT l_orderkey, o_orderdate, l_suppkey, l_extendedprice, CAST(l_linenumber AS BIGINT) AS rating, 'IMG' || l_orderkey AS name, CAST(l_orderkey % 7 AS VARCHAR) AS subsec,
    'd' || (l_suppkey % 5) || '/IMG' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(l_quantity AS INTEGER) || CASE l_linenumber % 4 WHEN 0 THEN '.HIF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' ELSE '.ARW' END AS path
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _files(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    ext = F.when(F.col("l_linenumber") % 4 == 0, ".HIF").when(F.col("l_linenumber") % 4 == 1, ".jpg").when(F.col("l_linenumber") % 4 == 2, ".png").otherwise(".ARW")
    j = li.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(
        "l_orderkey", "o_orderdate", F.col("l_linenumber").alias("rating"), F.concat(F.lit("IMG"), "l_orderkey").alias("name"), (F.col("l_orderkey") % 7).cast("string").alias("subsec"),
        F.concat(F.lit("d"), F.col("l_suppkey") % 5, F.lit("/IMG"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")), ext).alias("path"))


@query("a1_identity_groups", "WITH " + FILES_SQL + """, c AS (SELECT *, CASE WHEN path LIKE '%.HIF' THEN 0 WHEN path LIKE '%.jpg' THEN 1 WHEN path LIKE '%.png' THEN 2 ELSE 3 END AS cost, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext FROM files)
  SELECT l_orderkey, first(path ORDER BY cost, path) AS path, first(rating ORDER BY cost, path) AS rating, string_agg(DISTINCT ext, '|' ORDER BY ext) AS formats, count(*) AS files FROM c GROUP BY l_orderkey""")
def a1(spark, d):
    g = A.identity_groups(_files(spark, d), "name", "o_orderdate", "subsec", "path", ["l_orderkey", "rating"])
    return g.select("l_orderkey", "path", "rating", "formats", "files")


@query("a2_scan_report", """WITH f AS (SELECT event, t, star, CASE id % 3 WHEN 0 THEN 'hif' WHEN 1 THEN 'jpg' ELSE 'arw' END AS fmt, CASE WHEN id % 5 = 0 THEN NULL ELSE (id % 400)::DOUBLE END AS focal, CASE WHEN id % 2 = 0 THEN (id % 400) * 1.5::DOUBLE END AS equiv FROM items),
  q AS (SELECT *, CASE WHEN equiv > 0 THEN equiv WHEN focal > 0 THEN focal END AS eq FROM f),
  b AS (SELECT *, CASE WHEN eq IS NULL THEN 'unknown' WHEN eq < 20 THEN '<20' WHEN eq < 35 THEN '20-35' WHEN eq < 70 THEN '35-70' WHEN eq < 135 THEN '70-135' WHEN eq < 300 THEN '135-300' WHEN eq < 600 THEN '300-600' ELSE '>=600' END AS b FROM q)
  SELECT 'format/' || fmt AS name, count(*) AS rows, NULL::DOUBLE AS value FROM b GROUP BY fmt UNION ALL SELECT 'focal/' || b, count(*), NULL FROM b GROUP BY b UNION ALL SELECT 'star/' || star, count(*), NULL FROM b GROUP BY star
  UNION ALL SELECT 'event_star/' || event || '/' || star, count(*), NULL FROM b GROUP BY event, star UNION ALL SELECT 'event/' || event, count(*), round(avg((star >= 3)::INT), 6) FROM b GROUP BY event
  UNION ALL SELECT 'tele_star/' || star, count(*), NULL FROM b WHERE eq >= 135 GROUP BY star UNION ALL SELECT 'time_span', count(t), round((max(t) - min(t)) / 3.6e9, 6) FROM b""")
def a2(spark, d):
    f = views.items(spark, d).select(
        "event", "t", "star", F.when(F.col("id") % 3 == 0, "hif").when(F.col("id") % 3 == 1, "jpg").otherwise("arw").alias("fmt"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 400).cast("double")).alias("focal"), F.when(F.col("id") % 2 == 0, (F.col("id") % 400) * 1.5).alias("equiv"))
    return A.scan_report(f, "fmt", "focal", "equiv", "star", "event", "t")


@query("a3_event_inventory", """SELECT event, count(*) AS photos, count(DISTINCT owner || '/' || cluster) AS clusters, count(*) FILTER (cluster_size = 1) AS singletons, min(t) AS first, max(t) AS last, count(*) FILTER (id % 9 = 0) AS annotated FROM clustered GROUP BY event""")
def a3(spark, d):
    s = views.shots(spark, d).withColumn("ann", (F.col("id") % 9 == 0).cast("long"))
    return A.event_inventory(s, "event", CLUSTER, "t", "ann")


@query("a3_histogram_by", "SELECT event, CAST(star AS BIGINT) AS star, count(*) AS n FROM items GROUP BY ALL")
def a3_hist(spark, d):
    return A.histogram_by(views.items(spark, d), "event", "star")


@query("a4_group_distribution", """WITH s AS (SELECT owner, count(*) AS n, k, avg((star = k)::INT) AS p FROM items, range(0, 6) r(k) GROUP BY owner, k), q AS (SELECT k, avg((star = k)::INT) AS q FROM items, range(0, 6) r(k) GROUP BY k),
  kl AS (SELECT owner, n, sum(p * ln((p + 1e-6) / (q + 1e-6))) AS kl FROM s JOIN q USING (k) GROUP BY owner, n)
  SELECT 'star_' || k AS name, round(any_value(q), 6) AS a, round(avg(p), 6) AS b, round(stddev_pop(p), 6) AS c FROM s JOIN q USING (k) GROUP BY k
  UNION ALL SELECT 'kl_all', round(avg(kl), 6), round(quantile_cont(kl, 0.5), 6), round(max(kl), 6) FROM kl UNION ALL SELECT 'kl_large', round(avg(kl), 6), round(quantile_cont(kl, 0.5), 6), round(max(kl), 6) FROM kl WHERE n >= 65""")
def a4(spark, d):
    return A.group_distribution(views.items(spark, d), "owner", "star", large=65)


@query("a5_share_above", """WITH s AS (SELECT event, owner, seg, count(*) AS n, count(*) FILTER (star >= 3) AS h FROM shots GROUP BY ALL)
  SELECT round(sum(h) / sum(n), 6) AS overall, round(avg(h / n), 6) AS mean, round(stddev_pop(h / n), 6) AS std, round(min(h / n), 6) AS min, round(max(h / n), 6) AS max, count(*) FILTER (h = 0) AS zero, count(*) FILTER (h = 0 AND n < 4) AS zero_small FROM s""")
def a5(spark, d):
    return A.share_above(views.shots(spark, d), SEGMENT, "star", 3, small=4)


@query("a6_flag_coverage", """WITH f AS (SELECT event, star, CASE WHEN event = 'error' OR id % 10 = 0 THEN NULL ELSE CAST(id % 8 = 0 AS INT) END AS flag FROM items)
  SELECT event, CAST(star AS BIGINT) AS star, count(*) AS rows, count(*) FILTER (flag = 1) AS flagged, count(*) FILTER (flag IS NULL) AS unknown, round(count(*) FILTER (flag = 1) / nullif(count(flag), 0), 6) AS rate FROM f GROUP BY ALL""")
def a6(spark, d):
    f = views.items(spark, d).withColumn("flag", F.when((F.col("event") != "error") & (F.col("id") % 10 != 0), (F.col("id") % 8 == 0).cast("int")))
    return A.flag_coverage(f, ["event", "star"], "flag")


@query("a7_quantile_summary", """SELECT event, count(*) AS n, round(quantile_cont(value, 0.1), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p05, round(quantile_cont(value, 0.999), 6) AS p0999, round(avg((value >= 50)::INT), 6) AS ge_50, round(avg((value >= 100)::INT), 6) AS ge_100 FROM items GROUP BY event""")
def a7(spark, d):
    return A.quantile_summary(views.items(spark, d), "event", "value", {"p01": 0.1, "p05": 0.5, "p0999": 0.999}, [50, 100])


CROSS_SQL = """xa AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY {hash:cross-a:vec_id}, vec_id) AS r FROM vectors), xb AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY {hash:cross-b:vec_id}, vec_id) AS r FROM vectors),
  cr AS (SELECT list_dot_product(xa.v, xb.v) / (sqrt(list_dot_product(xa.v, xa.v)) * sqrt(list_dot_product(xb.v, xb.v))) AS cos FROM xa JOIN xb USING (r) WHERE xa.label <> xb.label AND xa.vec_id <> xb.vec_id ORDER BY r LIMIT 100000)"""


def _cross(spark, d):
    e = table(spark, d, "embeddings")
    p = P.cross_sample(e, "vec_id", "label", 100_000)
    a = e.select(F.col("vec_id").alias("vec_id_i"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("vec_id_j"), F.col("embedding").alias("b"))
    return p.join(a, "vec_id_i").join(b, "vec_id_j").select(V.cosine(F.col("a"), F.col("b")).alias("cos"))


@query("a7_separation", "WITH " + CROSS_SQL + """, w AS (SELECT cos FROM vecpairs), c AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]) AS cut)
  SELECT cut, round((SELECT avg((cos >= cut)::INT) FROM w), 6) AS "within", round((SELECT avg((cos >= cut)::INT) FROM cr), 6) AS "cross", round((SELECT avg((cos >= cut)::INT) FROM w) / nullif((SELECT avg((cos >= cut)::INT) FROM cr), 0), 6) AS ratio FROM c""")
def a7_sep(spark, d):
    return A.separation(V.similarity_counts(table(spark, d, "embeddings"), "vec_id", "embedding", [0.1, 0.2, 0.3], by="label"), _cross(spark, d), "cos", [0.1, 0.2, 0.3])


@query("a8_window_recall", """WITH p AS (SELECT event, owner, seg, id, score_b, row_number() OVER (PARTITION BY event, owner, seg ORDER BY t, id) AS pos, count(*) OVER (PARTITION BY event, owner, seg) AS n FROM scored),
  s AS (SELECT b.pos - a.pos AS d FROM p a JOIN p b ON a.event = b.event AND a.owner = b.owner AND a.seg = b.seg AND b.pos > a.pos AND b.pos <= a.pos + 12 AND abs(a.score_b - b.score_b) < 0.05)
  SELECT w AS width, round(count(*) FILTER (d <= w) / count(*), 6) AS recall, (SELECT CAST(sum(least(n - pos, w)) AS BIGINT) FROM p) AS pairs FROM s, (SELECT unnest([2::BIGINT, 4]) AS w) GROUP BY w""")
def a8(spark, d):
    s = views.with_scores(views.shots(spark, d))
    near = T.lag_pairs(s, SEGMENT, "t", 12, ["score_b"]).where(F.abs(F.col("score_b_i") - F.col("score_b_j")) < 0.05).select("id_i", "id_j")
    return A.window_recall(s, near, SEGMENT, "t", "id", [2, 4])


@query("a9_calibrate_thresholds", "WITH " + CROSS_SQL + """, w AS (SELECT cos FROM vecpairs), n AS (SELECT abs(a.value - b.value) AS d FROM items a JOIN items b ON a.owner = b.owner AND a.event = b.event AND a.star = b.star + 1)
  SELECT 0.98::DOUBLE AS tau_hi, round(greatest(0.5, least(0.95, ceil((SELECT quantile_cont(cos, 0.999) FROM cr) * 100) / 100)), 6) AS tau_lo, (SELECT round(quantile_cont(d, 0.4), 6) FROM n) AS tau_cv_p40, (SELECT round(quantile_cont(d, 0.6), 6) FROM n) AS tau_cv_p60,
   round(quantile_cont(cos, 0.5), 6) AS knot_p50, round(quantile_cont(cos, 0.75), 6) AS knot_p75, round(quantile_cont(cos, 0.9), 6) AS knot_p90, round(quantile_cont(cos, 0.98), 6) AS knot_p98 FROM w""")
def a9(spark, d):
    from starfold.operators.joins import cross_class_pairs

    p = cross_class_pairs(views.items(spark, d), ["owner", "event"], "id", "star", ["value"], max_gap=1)
    knots = V.similarity_quantiles(table(spark, d, "embeddings"), "vec_id", "embedding", A.KNOTS, by="label")
    return A.calibrate_thresholds(knots, _cross(spark, d), p.select(F.abs(F.col("value_i") - F.col("value_j")).alias("dist")), "cos", "dist")


@query("a10_conditional_retain", """WITH q AS (SELECT *, row_number() OVER (PARTITION BY event, owner, seg ORDER BY t, id) AS pos FROM scored),
  p AS (SELECT a.id AS id_i, b.id AS id_j, CASE WHEN a.star = b.star THEN 'same' ELSE 'diff' END AS layer, CASE WHEN (a.id + b.id) % 7 = 0 THEN NULL ELSE abs(a.score_b - b.score_b) END AS dist FROM q a JOIN q b ON a.event = b.event AND a.owner = b.owner AND a.seg = b.seg AND b.pos > a.pos AND b.pos <= a.pos + 3),
  c AS (SELECT layer, quantile_cont(dist, 0.4) AS cut FROM p GROUP BY layer) SELECT layer, id_i, id_j, round(dist, 6) AS dist FROM p JOIN c USING (layer) WHERE dist > cut""")
def a10(spark, d):
    s = views.with_scores(views.shots(spark, d))
    p = T.lag_pairs(s, SEGMENT, "t", 3, ["score_b", "star"])
    p = p.select("id_i", "id_j", F.when(F.col("star_i") == F.col("star_j"), "same").otherwise("diff").alias("layer"),
                 F.when((F.col("id_i") + F.col("id_j")) % 7 != 0, F.abs(F.col("score_b_i") - F.col("score_b_j"))).alias("dist"))
    return A.conditional_retain(p, "layer", "dist", 0.4)


@query("a11_variance_shares", """WITH s AS (SELECT event, owner, count(*) AS n, avg(star) AS m, sum(star * star) - count(*) * avg(star) ** 2 AS ss FROM items GROUP BY ALL), e AS (SELECT event, avg(star) AS em, count(*) AS en FROM items GROUP BY event),
  t AS (SELECT (SELECT sum(en * (em - (SELECT avg(star) FROM items)) ** 2) FROM e) AS a, (SELECT sum(n * (m - em) ** 2) FROM s JOIN e USING (event)) AS b, (SELECT sum(ss) FROM s) AS c)
  SELECT round(a / (a + b + c), 6) AS event_share, round(b / (a + b + c), 6) AS seg_share, round(c / (a + b + c), 6) AS within_share, (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM s) AS segments FROM t""")
def a11(spark, d):
    return A.variance_shares(views.items(spark, d), "event", "owner", "star")


@query("a11_between_share", """SELECT round((SELECT sum(n * (m - (SELECT avg(value) FROM items)) ** 2) FROM (SELECT count(*) AS n, avg(value) AS m FROM items GROUP BY owner)) / (SELECT var_pop(value) * count(*) FROM items), 6) AS between_share""")
def a11_between(spark, d):
    return A.between_share(views.items(spark, d), "owner", "value")


@query("a12_mean_table", "SELECT event, count(*) AS n, round(sum(star * value) / sum(star), 6) AS mean FROM items GROUP BY event")
def a12(spark, d):
    return A.mean_table(views.items(spark, d), "event", "value", "star")


def _star_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("event"), "embedding", (F.col("vec_id") % 6).alias("star"))


@query("a13_co_promotion", """WITH p AS (SELECT CAST(CASE WHEN cos < 0.2 THEN 0 WHEN cos < 0.3 THEN 1 ELSE 2 END AS BIGINT) AS band, id_i % 6 AS a, id_j % 6 AS b FROM vecpairs WHERE cos >= 0.1 AND cos < 1.01)
  SELECT k, band, count(*) AS pairs, round(avg((least(a, b) >= k)::INT), 6) AS p_both FROM p, (SELECT unnest([1::BIGINT, 3]) AS k) WHERE greatest(a, b) >= k GROUP BY ALL""")
def a13(spark, d):
    return A.co_promotion(_star_vectors(spark, d), "event", "id", "embedding", "star", [0.1, 0.2, 0.3, 1.01])


@query("a14_positive_sibling", """WITH e AS (SELECT id_i AS id, id_j AS o, cos FROM vecpairs UNION ALL SELECT id_j, id_i, cos FROM vecpairs), b AS (SELECT id, max(cos) AS best FROM e WHERE id % 6 = 0 AND o % 6 >= 1 AND cos >= 0.15 GROUP BY id)
  SELECT cut, (SELECT count(*) FROM vectors WHERE vec_id % 6 = 0) AS zero, round((SELECT count(*) FROM b WHERE best >= cut) / (SELECT count(*) FROM vectors WHERE vec_id % 6 = 0), 6) AS share FROM (SELECT unnest([0.15::DOUBLE, 0.25::DOUBLE, 0.35::DOUBLE]) AS cut)""")
def a14(spark, d):
    return A.positive_sibling(_star_vectors(spark, d), "event", "id", "embedding", "star", [0.15, 0.25, 0.35])


@query("a15_cross_tab", "SELECT CAST(star AS BIGINT) AS star, count(*) FILTER (user_star = 0) AS c0, count(*) FILTER (user_star = 1) AS c1, count(*) FILTER (user_star = 2) AS c2, count(*) FILTER (user_star = 3) AS c3, count(*) FILTER (user_star = 4) AS c4, count(*) FILTER (user_star = 5) AS c5 FROM exam GROUP BY star")
def a15(spark, d):
    return A.cross_tab(views.exam(spark, d), "star", "user_star", [0, 1, 2, 3, 4, 5])


@query("a15_spearman", """WITH r AS (SELECT event, rank() OVER (PARTITION BY event ORDER BY star) + (count(*) OVER (PARTITION BY event, star) - 1) / 2 AS a, rank() OVER (PARTITION BY event ORDER BY score_b) + (count(*) OVER (PARTITION BY event, score_b) - 1) / 2 AS b FROM itemscores)
  SELECT event, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY event""")
def a15_spearman(spark, d):
    s = views.with_scores(views.items(spark, d)).withColumn("star", F.col("star").cast("double"))
    return A.spearman(s, "event", "star", "score_b")


LP_SQL = """lp AS (SELECT a.gid, a.event, a.owner, CASE WHEN a.user_star > b.user_star THEN a.id ELSE b.id END AS winner, CASE WHEN a.user_star > b.user_star THEN b.id ELSE a.id END AS loser, abs(a.user_star - b.user_star) AS dstar,
    CASE abs(a.user_star - b.user_star) WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS weight FROM exam a JOIN exam b ON a.gid = b.gid AND a.id < b.id AND a.user_star <> b.user_star)"""


@query("a16_exposure_ledger", "WITH " + LP_SQL + """, x AS (SELECT *, CASE WHEN dstar >= 2 THEN 'golden' ELSE 'window' END AS source, (winner + loser) % 40 AS batch FROM lp)
  SELECT source, count(*) AS draws, count(DISTINCT least(winner, loser) || '-' || greatest(winner, loser)) AS unique_pairs, count(DISTINCT batch) AS batches, count(DISTINCT event) AS events,
    (SELECT count(DISTINCT i) FROM (SELECT winner AS i, source AS s FROM x UNION ALL SELECT loser, source FROM x) u WHERE u.s = x.source) AS unique_items FROM x GROUP BY source""")
def a16(spark, d):
    p = L.label_pairs(views.exam(spark, d), "gid", "id", "user_star", ["event"])
    x = p.select("winner", "loser", F.col("event_winner").alias("event"), F.when(F.col("dstar") >= 2, "golden").otherwise("window").alias("source"), ((F.col("winner") + F.col("loser")) % 40).alias("batch"))
    return A.exposure_ledger(x, "batch")


@query("a17_near_duplicate_distance", """WITH x AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE v[1] END AS a, v[2] AS b FROM vectors), s AS (SELECT stddev_pop(a) AS s1, stddev_pop(b) AS s2 FROM x),
  d AS (SELECT sqrt(coalesce(((i.a - j.a) / s1) ** 2, 0) + ((i.b - j.b) / s2) ** 2) AS d FROM vecpairs p JOIN x i ON i.vec_id = id_i JOIN x j ON j.vec_id = id_j, s WHERE cos >= 0.2)
  SELECT count(*) AS pairs, count(d) AS valid, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.25), 6) AS p25, round(quantile_cont(d, 0.4), 6) AS p40, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.6), 6) AS p60, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90 FROM d""")
def a17(spark, d):
    e = _star_vectors(spark, d).withColumn("a", F.when(F.col("id") % 11 != 0, F.col("embedding")[0].cast("double"))).withColumn("b", F.col("embedding")[1].cast("double"))
    return A.near_duplicate_distance(e, "event", "id", "embedding", ["a", "b"], 0.2)


# --- labels ------------------------------------------------------------------------------------------------------

VERDICT_SQL = """vd AS (SELECT gid, max(user_star) AS top, count(*) FILTER (user_star = m) AS n_top, min(id) FILTER (user_star = m) AS w, CASE WHEN max(user_star) = 0 THEN 'tie0' WHEN count(*) FILTER (user_star = m) > 1 THEN 'tie' ELSE 'win' END AS status
  FROM (SELECT *, max(user_star) OVER (PARTITION BY gid) AS m FROM exam) GROUP BY gid)"""


@query("l1_group_verdict", "WITH " + VERDICT_SQL + " SELECT gid, CAST(top AS BIGINT) AS top, n_top, status, CASE WHEN status = 'win' THEN w END AS winner FROM vd")
def l1(spark, d):
    return L.group_verdict(views.exam(spark, d), "gid", "id", "user_star")


@query("l1_verdict_agreement", "WITH " + VERDICT_SQL + """ SELECT status, count(*) AS groups, count(*) FILTER (status = 'win' AND e.star = o.m) AS agree FROM vd LEFT JOIN exam e ON e.gid = vd.gid AND e.id = vd.w
  JOIN (SELECT gid, max(star) AS m FROM exam GROUP BY gid) o ON o.gid = vd.gid GROUP BY status""")
def l1_agree(spark, d):
    return L.verdict_agreement(views.exam(spark, d), "gid", "id", "user_star", "star")


@query("l2_label_pairs", "WITH " + LP_SQL + " SELECT gid, winner, loser, CAST(dstar AS BIGINT) AS dstar, weight FROM lp")
def l2(spark, d):
    return L.label_pairs(views.exam(spark, d), "gid", "id", "user_star")


@query("l3_interval_pairs", """WITH r AS (SELECT owner AS session, split, id % 4 + 4 * event_no AS item, user_star FROM (SELECT e.owner, s.split, e.id, e.user_star, length(e.event) AS event_no FROM exam e JOIN splits s ON s.id = e.id)),
  i AS (SELECT session, split, item, min(user_star) AS lo, max(user_star) AS hi FROM r GROUP BY ALL)
  SELECT a.session, a.split, a.item AS winner, b.item AS loser, CAST(a.lo - b.hi AS BIGINT) AS dstar, CASE WHEN a.lo - b.hi = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM i a JOIN i b ON a.session = b.session AND a.split = b.split AND a.lo > b.hi""")
def l3(spark, d):
    e = views.with_split(views.exam(spark, d))
    r = e.select(F.col("owner").alias("session"), "split", (F.col("id") % 4 + 4 * F.length("event")).alias("item"), "user_star")
    return L.interval_pairs(r, "session", "item", "user_star", "split")


DEC_SQL = """dec AS (SELECT gid, id, CASE WHEN {hash:gs:gid} % 5 = 0 THEN 'tie' ELSE 'ranked' END AS group_status, CASE WHEN {hash:gs:gid} % 5 = 0 AND id % 50 <> 1 THEN 'tie' WHEN id % 60 = 2 THEN 'tie' WHEN user_star >= 2 THEN 'keep' ELSE 'drop' END AS decision FROM exam)"""


def _decisions(spark, d):
    tie = hash_int("gs", "gid") % 5 == 0
    dec = F.when(tie & (F.col("id") % 50 != 1), "tie").when(F.col("id") % 60 == 2, "tie").when(F.col("user_star") >= 2, "keep").otherwise("drop")
    return views.exam(spark, d).select("gid", "id", F.when(tie, "tie").otherwise("ranked").alias("group_status"), dec.alias("decision"))


@query("l4_decision_errors", "WITH " + DEC_SQL + """ SELECT gid, id, CASE WHEN group_status = 'tie' THEN 'tie_group_with_decision' ELSE 'ranked_group_with_tie' END AS error FROM dec WHERE (group_status = 'tie') <> (decision = 'tie')""")
def l4_errors(spark, d):
    return L.decision_errors(_decisions(spark, d), "gid", "id")


@query("l4_keep_drop_pairs", "WITH " + DEC_SQL + """ SELECT a.gid, a.id AS winner, b.id AS loser FROM dec a JOIN dec b ON a.gid = b.gid WHERE a.group_status = 'ranked' AND a.decision = 'keep' AND b.decision = 'drop'""")
def l4(spark, d):
    return L.keep_drop_pairs(_decisions(spark, d), "gid", "id")


MIX_SQL = LP_SQL + """, old AS (SELECT CASE WHEN a.star > b.star THEN a.id ELSE b.id END AS winner, CASE WHEN a.star > b.star THEN b.id ELSE a.id END AS loser, a.event, a.gid FROM exam a JOIN exam b ON a.gid = b.gid AND a.id < b.id AND a.star <> b.star),
  mx AS (SELECT winner, loser, weight, event, gid AS grp, 'golden' AS source FROM lp UNION ALL SELECT winner, loser, 0.25::DOUBLE + (winner % 3) / 4.0::DOUBLE, event, gid, 'window' FROM old)"""


def _mixed(spark, d):
    e = written(views.exam(spark, d).select("gid", "id", "event", "user_star", "star"))
    p = L.label_pairs_of(e, "gid", "id", {"golden": "user_star", "window": "star"}, ["event"])
    weight = F.when(F.col("source") == "golden", F.col("weight")).otherwise(0.25 + (F.col("winner") % 3) / 4.0)
    return p.select("winner", "loser", weight.alias("weight"), F.col("event_winner").alias("event"), F.col("gid").alias("group"), "source")


@query("l5_find_conflicts", "WITH " + MIX_SQL + """ SELECT least(winner, loser) AS "left", greatest(winner, loser) AS "right", count(*) AS rows FROM mx GROUP BY 1, 2 HAVING count(DISTINCT winner) > 1""")
def l5(spark, d):
    return L.find_conflicts(_mixed(spark, d))


@query("l5_quarantine", "WITH " + MIX_SQL + """ SELECT winner, loser, source FROM mx QUALIFY min(winner) OVER (PARTITION BY least(winner, loser), greatest(winner, loser)) = max(winner) OVER (PARTITION BY least(winner, loser), greatest(winner, loser))""")
def l5_quarantine(spark, d):
    return L.quarantine(_mixed(spark, d)).select("winner", "loser", "source")


@query("l6_dedupe_pairs", "WITH " + MIX_SQL + " SELECT winner, loser, min(weight) AS weight FROM mx GROUP BY ALL")
def l6(spark, d):
    return L.dedupe_pairs(_mixed(spark, d), ["winner", "loser"])


@query("l7_source_weights", "WITH " + MIX_SQL + """, m AS (SELECT source, event, sum(weight) AS mass FROM mx GROUP BY ALL), k AS (SELECT source, count(*) AS domains FROM m GROUP BY source)
  SELECT winner, loser, source, round(weight / mass * CASE source WHEN 'golden' THEN 0.05 ELSE 0.5 END::DOUBLE / domains / 0.55::DOUBLE, 6) AS weight FROM mx JOIN m USING (source, event) JOIN k USING (source)""")
def l7(spark, d):
    return L.source_weights(_mixed(spark, d), ["event"]).select("winner", "loser", "source", "weight")


@query("l8_duplicate_consistency", """WITH r AS (SELECT owner || '/' || event || '/' || (id % 20) AS k, user_star FROM exam), g AS (SELECT k, max(user_star) - min(user_star) AS diff FROM r GROUP BY k HAVING count(*) = 2)
  SELECT CAST(diff AS BIGINT) AS diff, count(*) AS items, CAST(diff >= 2 AS BIGINT) AS is_jump FROM g GROUP BY diff""")
def l8(spark, d):
    e = views.exam(spark, d).withColumn("k", F.concat_ws("/", "owner", "event", F.col("id") % 20))
    return L.duplicate_consistency(e, "k", "user_star")


@query("l9_copeland", """WITH s AS (SELECT gid, rnd, max(user_star) AS top, count(*) FILTER (user_star = m) AS k FROM (SELECT *, max(user_star) OVER (PARTITION BY gid, rnd) AS m FROM rounds) GROUP BY ALL),
  st AS (SELECT gid, min((top > 0 AND k = 1)::INT) AS ok FROM s GROUP BY gid),
  v AS (SELECT a.gid, a.id AS i, b.id AS j, count(*) FILTER (a.user_star > b.user_star) AS up, count(*) FILTER (a.user_star < b.user_star) AS dn FROM rounds a JOIN rounds b ON a.gid = b.gid AND a.rnd = b.rnd AND a.id < b.id GROUP BY ALL),
  w AS (SELECT gid, CASE WHEN up > dn THEN i ELSE j END AS id FROM v WHERE greatest(up, dn) >= 2 AND up <> dn), c AS (SELECT gid, id, count(*) AS wins FROM w GROUP BY ALL),
  m AS (SELECT e.gid, e.id, coalesce(wins, 0) AS wins FROM exam e LEFT JOIN c USING (gid, id)), r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY wins DESC, id) AS r FROM m),
  z AS (SELECT r.*, max(wins) OVER (PARTITION BY gid) AS b, max(CASE WHEN r = 2 THEN wins END) OVER (PARTITION BY gid) AS s2, ok FROM r JOIN st USING (gid)),
  q AS (SELECT *, CASE WHEN ok = 0 THEN 'undecided_round' WHEN b = s2 THEN 'no_champion' ELSE 'ok' END AS status FROM z)
  SELECT gid, id, wins, status, CAST(status = 'ok' AND r = 1 AS BIGINT) AS is_champion, CAST(status = 'ok' AND wins >= s2 AS BIGINT) AS is_top2 FROM q""")
def l9(spark, d):
    return L.copeland(views.rounds(spark, d), "gid", "id", "user_star", "rnd")


@query("l10_retest_agreement", """WITH v AS (SELECT gid, rnd, max(user_star) AS top, count(*) FILTER (user_star = m) AS k, min(id) FILTER (user_star = m) AS w FROM (SELECT *, max(user_star) OVER (PARTITION BY gid, rnd) AS m FROM rounds) GROUP BY ALL),
  j AS (SELECT a.gid, a.w AS w1, b.w AS w2, a.top > 0 AND a.k = 1 AND b.top > 0 AND b.k = 1 AS bth FROM v a JOIN v b ON a.gid = b.gid AND a.rnd = 0 AND b.rnd = 1),
  s AS (SELECT gid, id, user_star, row_number() OVER (PARTITION BY gid ORDER BY user_star DESC, id) AS r FROM rounds WHERE rnd = 0)
  SELECT count(*) FILTER (bth) AS decided, count(*) FILTER (NOT bth) AS skipped, count(*) FILTER (bth AND w1 = w2) AS agree, count(*) FILTER (bth AND p.user_star >= q.user_star) AS top_two
  FROM j JOIN s p ON p.gid = j.gid AND p.id = j.w2 JOIN s q ON q.gid = j.gid AND q.r = 2""")
def l10(spark, d):
    r = views.rounds(spark, d)
    return L.retest_agreement(r.where("rnd = 0"), r.where("rnd = 1"), "gid", "id", "user_star")


@query("l11_constraint_sets", """WITH an AS (SELECT gid, id, user_star, CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM exam),
  a AS (SELECT x.id AS winner, y.id AS loser, x.w * y.w * CASE WHEN x.user_star - y.user_star = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight, 'anchor' AS kind FROM an x JOIN an y ON x.gid = y.gid AND x.user_star > y.user_star),
  sg AS (SELECT event, owner, seg, count(*) AS n, max(star) AS cap FROM scored GROUP BY ALL HAVING count(*) >= 8), tp AS (SELECT g.event, s.id, g.cap, row_number() OVER (PARTITION BY g.event, g.owner, g.seg ORDER BY s.star DESC, s.score_b DESC, s.id DESC) AS r FROM sg g JOIN scored s USING (event, owner, seg)),
  c AS (SELECT x.id AS winner, y.id AS loser, 0.5::DOUBLE AS weight, 'cap' AS kind FROM tp x JOIN tp y ON x.event = y.event AND x.r = 1 AND y.r = 1 AND x.cap >= 4 AND y.cap <= 3),
  lw AS (SELECT event, id, row_number() OVER (PARTITION BY event ORDER BY {hash:flag:id}, id) AS rk, count(*) OVER (PARTITION BY event) AS n FROM scored WHERE star <= 2 AND id % 10 <> 0),
  fx AS (SELECT s.event, s.id, m, n, (m * n) // least(5, n) AS f, ((m + 1) * n) // least(5, n) - (m * n) // least(5, n) AS wd FROM scored s JOIN (SELECT DISTINCT event, n FROM lw) USING (event), range(0, 5) r(m) WHERE s.id % 10 = 0 AND m < n),
  fl AS (SELECT fx.id AS winner, lw.id AS loser, 0.2::DOUBLE AS weight, 'flag' AS kind FROM fx JOIN lw ON lw.event = fx.event AND lw.rk = f + {hash:flag:fx.id,m} % wd + 1)
  SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM fl""")
def l11(spark, d):
    an = views.exam(spark, d).withColumn("w", F.when(F.col("id") % 3 == 0, 0.5).otherwise(1.0))
    s = views.with_scores(views.shots(spark, d)).withColumn("ret", (F.col("id") % 10 == 0).cast("int"))
    a = L.anchor_constraints(an, "gid", "id", "user_star", "w")
    c = L.cap_constraints(s, "event", SEGMENT, "id", "star", "score_b", big=8)
    return a.unionByName(c).unionByName(L.flagged_constraints(s, "event", "id", "star", "ret"))


@query("l12_choose_events", """SELECT owner, count(DISTINCT gid) AS groups FROM exam GROUP BY owner HAVING count(DISTINCT gid) >= 5 ORDER BY sha256('dev:' || owner) LIMIT 10""")
def l12(spark, d):
    return L.choose_events(views.exam(spark, d), "owner", "gid", 5, 10, "dev")


@query("l13_assemble_preferences", "WITH " + MIX_SQL + """ SELECT source, CASE WHEN source = 'window' AND event = 'view' THEN 'development_event' WHEN event = 'view' THEN 'development_event' END AS skipped, count(*) AS pairs, round(sum(weight), 6) AS weight FROM mx GROUP BY ALL
  UNION ALL SELECT 'derived', 'excluded_source', count(*), round(sum(weight), 6) FROM lp""")
def l13(spark, d):
    m = _mixed(spark, d)
    lp = m.where("source = 'golden'")
    dev = views.items(spark, d).where("event = 'view'").select("event")
    out = L.assemble_preferences({"golden": lp, "window": m.where("source = 'window'"), "derived": lp}, dev)
    return out.groupBy("source", "skipped").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").alias("weight"))


@query("l13_preference_errors", "WITH " + LP_SQL + """ SELECT winner, loser, 'outside_split' AS error FROM lp WHERE winner IN (SELECT id FROM splits WHERE split <> 'train')""")
def l13_errors(spark, d):
    i = views.with_split(views.items(spark, d))
    return L.preference_errors(_mixed(spark, d).where("source = 'golden'"), i, "id", "split").select("winner", "loser", "error")
