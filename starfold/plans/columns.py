"""Queries of scalar functions and grid columns (P, E5-E16, V9, U1, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.core import hash_int
from starfold.functions import grids as G
from starfold.functions import scalars as S
from starfold.functions import vectors as V
from starfold.operators import segments as T
from starfold.plans import views
from starfold.plans.registry import query
from starfold.plans.views import SEGMENT, table


@query("p1_tier", "SELECT id, CAST(least(star, 3) AS BIGINT) AS tier, CAST(star >= 2 AS BIGINT) AS ge2 FROM items")
def p1(spark, d):
    return views.items(spark, d).select("id", S.tier(F.col("star")).alias("tier"), S.at_least(F.col("star"), 2).alias("ge2"))


@query("p2_normalise_event", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS s FROM documents)
  SELECT doc_id, CASE WHEN coalesce(trim(s) = '', true) THEN 'legacy' ELSE s END AS event, coalesce(trim(s) = '', true) AS was_blank FROM x""")
def p2(spark, d):
    s = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 7 != 0, F.col("source"))
    event, blank = S.normalise_event(s, "legacy")
    return table(spark, d, "documents").select("doc_id", event.alias("event"), blank.alias("was_blank"))


@query("p3_parse_time", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) + CASE event_id % 3 WHEN 0 THEN 250000 WHEN 1 THEN 70000 ELSE 0 END END AS us FROM events""")
def p3(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 11 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    sub = F.when(F.col("event_id") % 3 == 0, "25").when(F.col("event_id") % 3 == 1, "07").otherwise("x")
    return e.select("event_id", F.unix_micros(S.parse_time(text, sub)).alias("us"))


@query("p5_excluded_by_keyword", """SELECT page_id, len(list_filter(string_split_regex(lower(url), '[/\\\\]'), lambda c: contains(c, '/') OR contains(c, 'fr') OR contains(c, '82'))) > 0 AS excluded FROM pages""")
def p5(spark, d):
    return table(spark, d, "pages").select("page_id", S.excluded_by_keyword(F.col("url"), ["FR", "82"]).alias("excluded"))


FOCAL_SQL = """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size * 12.0::DOUBLE END AS focal, CASE WHEN p_partkey % 3 = 0 THEN p_size * 18.0::DOUBLE END AS equiv FROM part),
  q AS (SELECT *, CASE WHEN focal > 0 AND equiv > 0 THEN equiv / focal END AS crop, CASE WHEN equiv > 0 THEN equiv WHEN focal > 0 THEN focal END AS eq FROM f)"""


@query("p6_focal", FOCAL_SQL + """ SELECT p_partkey, round(crop, 6) AS crop, round(eq, 6) AS eq, CASE WHEN eq IS NULL THEN 'unknown' WHEN eq < 20 THEN '<20' WHEN eq < 35 THEN '20-35' WHEN eq < 70 THEN '35-70'
    WHEN eq < 135 THEN '70-135' WHEN eq < 300 THEN '135-300' WHEN eq < 600 THEN '300-600' ELSE '>=600' END AS bucket FROM q""")
def p6(spark, d):
    f = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 12.0).alias("focal"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 18.0).alias("equiv"))
    eq = S.equivalent_focal(F.col("focal"), F.col("equiv"))
    return f.select("p_partkey", S.crop_factor(F.col("focal"), F.col("equiv")).alias("crop"), eq.alias("eq"), S.focal_bucket(eq).alias("bucket"))


@query("p7_log_features", """SELECT p_partkey, round(ln(greatest(coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_size * 12.0::DOUBLE END, 0.001), 0.001)), 6) AS log_focal, CAST(p_partkey % 4 = 0 AS BIGINT) AS missing FROM part""")
def p7(spark, d):
    value, missing = S.log_features(F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 12.0), 1e-3)
    return table(spark, d, "part").select("p_partkey", value.alias("log_focal"), missing.alias("missing"))


@query("p8_piecewise_weight", """WITH x AS (SELECT id, 0.7 + (id % 311) / 1000.0::DOUBLE AS c FROM items)
  SELECT id, round(CASE WHEN c < 0.73 THEN 0 WHEN c < 0.786 THEN 0.3 + (c - 0.73) * 0.2 / 0.056 WHEN c < 0.918 THEN 0.5 + (c - 0.786) * 0.3 / 0.132 WHEN c < 0.973 THEN 0.8 + (c - 0.918) * 0.2 / 0.055 ELSE 1.0 END::DOUBLE, 6) AS weight FROM x""")
def p8(spark, d):
    return views.items(spark, d).select("id", S.piecewise_weight(0.7 + (F.col("id") % 311) / 1000.0).alias("weight"))


@query("p9_gap_factor", """SELECT star, CASE WHEN star = 3 THEN 0.5::DOUBLE WHEN star >= 4 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS factor, CASE WHEN star = 1 THEN 0.5::DOUBLE WHEN star = 2 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS confidence, count(*) AS n
  FROM (SELECT CAST(star AS BIGINT) AS star FROM items) GROUP BY ALL""")
def p9(spark, d):
    return views.items(spark, d).groupBy("star").agg(F.count(F.lit(1)).alias("n")).select(
        "star", S.gap_factor(F.col("star")).alias("factor"), S.confidence_weight(F.col("star")).alias("confidence"), "n")


@query("p10_fold_angle", """WITH a AS (SELECT o_orderkey, o_totalprice / 100 - 1000 AS x FROM orders), b AS (SELECT o_orderkey, x, (x + 45) - 90 * floor((x + 45) / 90) - 45 AS f FROM a)
  SELECT o_orderkey, round(f, 6) AS folded, round(((f - 10 + 45) - 90 * floor((f - 10 + 45) / 90)) - 45, 6) AS diff FROM b""")
def p10(spark, d):
    f = S.fold_angle(F.col("o_totalprice") / 100 - 1000)
    return table(spark, d, "orders").select("o_orderkey", f.alias("folded"), S.angle_difference(f, F.lit(10.0)).alias("diff"))


@query("p11_hash_order", """SELECT id, sha256('20260926:' || id) AS h, CAST(CAST('0x' || substr(sha256('half:' || id), 1, 8) AS BIGINT) % 2 AS BIGINT) AS half FROM items""")
def p11(spark, d):
    return views.items(spark, d).select("id", S.hash_order("20260926", F.col("id")).alias("h"), S.hash_half("half", F.col("id")).alias("half"))


XMP_SQL = """WITH x AS (SELECT doc_id, text || '<xmp:Rating>' || (doc_id % 6) || '</xmp:Rating>' || CASE WHEN doc_id % 2 = 0 THEN ' xmp:Rating="' || (doc_id % 9) || '"' ELSE '' END AS t,
  CASE WHEN doc_id % 4 = 0 THEN '<xmp:Rating>-1</xmp:Rating>' END AS side FROM documents)"""


def _xmp(spark, d):
    k = F.col("doc_id")
    attr = F.when(k % 2 == 0, F.concat(F.lit(' xmp:Rating="'), (k % 9).cast("string"), F.lit('"'))).otherwise("")
    return table(spark, d, "documents").select(
        "doc_id", F.concat("text", F.lit("<xmp:Rating>"), (k % 6).cast("string"), F.lit("</xmp:Rating>"), attr).alias("t"),
        F.when(k % 4 == 0, "<xmp:Rating>-1</xmp:Rating>").alias("side"))


@query("p12_mask_attribute", XMP_SQL + """, m AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, 'xmp:Rating>[0-5]<', 'xmp:Rating>0<', 'g'), 'xmp:Rating="[0-5]"', 'xmp:Rating="0"', 'g') AS m FROM x)
  SELECT doc_id, md5(m) AS masked, length(m) = length(t) AS same_length, regexp_matches(m, 'xmp:Rating>[1-5]') OR regexp_matches(m, 'xmp:Rating="[1-5]') AS residue FROM m""")
def p12(spark, d):
    m = S.mask_attribute(F.col("t"))
    return _xmp(spark, d).select("doc_id", F.md5(m).alias("masked"), (F.length(m) == F.length("t")).alias("same_length"), S.has_rating_residue(m).alias("residue"))


@query("p13_extract_rating", XMP_SQL + """ SELECT doc_id, CAST(greatest(0, least(5, list_max(list_transform(list_concat(list_concat(regexp_extract_all(t, '<xmp:Rating>([-0-9]+)</xmp:Rating>', 1),
    regexp_extract_all(t, 'xmp:Rating="([-0-9]+)"', 1)), regexp_extract_all(coalesce(side, ''), '<xmp:Rating>([-0-9]+)</xmp:Rating>', 1)), lambda s: s::INT)))) AS BIGINT) AS rating FROM x""")
def p13(spark, d):
    return _xmp(spark, d).select("doc_id", S.extract_rating(F.col("t"), F.col("side")).alias("rating"))


@query("p14_tilt_probabilities", """WITH h AS (SELECT id, value, {hash:p0:id} % 100 + 1 AS a, {hash:p1:id} % 100 + 1 AS b, {hash:p2:id} % 100 + 1 AS c, {hash:p3:id} % 100 + 1 AS e FROM items),
  l AS (SELECT id, ln(a / (a + b + c + e)::DOUBLE) AS l0, ln(b / (a + b + c + e)::DOUBLE) + 0.5 * value / 500 AS l1, ln(c / (a + b + c + e)::DOUBLE) + value / 500 AS l2, ln(e / (a + b + c + e)::DOUBLE) + 1.5 * value / 500 AS l3 FROM h)
  SELECT id, round(exp(l0) / (exp(l0) + exp(l1) + exp(l2) + exp(l3)), 6) AS q0, round(exp(l3) / (exp(l0) + exp(l1) + exp(l2) + exp(l3)), 6) AS q3 FROM l""")
def p14(spark, d):
    i = views.items(spark, d).withColumn("h", F.array(*[hash_int(f"p{k}", "id") % 100 + 1 for k in range(4)]))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + x)
    i = i.withColumn("total", total).withColumn("p", F.transform("h", lambda x: x / F.col("total")))
    t = i.withColumn("q", S.tilt_probabilities(F.col("p"), F.col("value") / 500, 0.5))
    return t.select("id", F.col("q")[0].alias("q0"), F.col("q")[3].alias("q3"))


# --- grids: an embedding read as 4 scalars on 4 x 4 cells, or as one plane of 8 x 8 ------------------------------

CELL_SQL = """WITH cells AS (SELECT vec_id, (i - 1) // 16 AS scalar, ((i - 1) % 16) // 4 AS "row", (i - 1) % 4 AS col, CASE WHEN v[i] > 0.25 OR (vec_id % 50 = 7 AND i <= 16) THEN NULL ELSE v[i] END AS v FROM vectors, range(1, 65) g(i)),
  plane AS (SELECT vec_id, label, vec_id // 5 AS gid, (i - 1) // 8 AS "row", (i - 1) % 8 AS col, CASE WHEN v[i] > 0.25 THEN NULL ELSE v[i] END AS v, v[i] AS raw FROM vectors, range(1, 65) g(i))"""


def _nan_grid(spark, d):
    bad = lambda x, i: (x > 0.25) | ((F.col("vec_id") % 50 == 7) & (i < 16))
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(
        V.as_double(F.col("embedding")), lambda x, i: F.when(bad(x, i), F.lit(float("nan"))).otherwise(x)).alias("grid"))


def _cells(spark, d):
    return G.cells(_nan_grid(spark, d), ["vec_id"], "grid", 4)


def _plane(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("gid"), F.posexplode(V.as_double(F.col("embedding"))).alias("p", "raw"))
    return e.select("vec_id", "gid", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), F.when(F.col("raw") <= 0.25, F.col("raw")).alias("v"), "raw")


@query("e5_grid_stats", CELL_SQL + """ SELECT vec_id, scalar, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.1), 6) AS p10, round(min(v), 6) AS min, CAST(count(v) = 0 AS BIGINT) AS missing FROM cells GROUP BY ALL""")
def e5(spark, d):
    return G.grid_stats(_cells(spark, d), ["vec_id"])


@query("e5_grid_means", CELL_SQL + """ SELECT vec_id, round(avg(v) FILTER (scalar = 0), 6) AS sharp, round(avg(v) FILTER (scalar = 1), 6) AS shake, round(avg(v) FILTER (scalar = 3), 6) AS contrast FROM cells GROUP BY vec_id""")
def e5_means(spark, d):
    return G.grid_means(_cells(spark, d), ["vec_id"], {"sharp": 0, "shake": 1, "contrast": 3})


def _tokens(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.as_double(F.col("embedding"))).alias("p", "v"))
    t = F.floor(F.col("p") / 4).cast("int")
    return e.select("vec_id", t.alias("token"), F.floor(t / 4).cast("int").alias("row"), (t % 4).cast("int").alias("col"), (F.col("p") % 4).cast("int").alias("dim"), "v")


TOKEN_SQL = """WITH tok AS (SELECT vec_id, (i - 1) // 4 AS token, ((i - 1) // 4) // 4 AS "row", ((i - 1) // 4) % 4 AS col, (i - 1) % 4 AS dim, v[i] AS v FROM vectors, range(1, 65) g(i))"""


@query("e6_pool_tokens", TOKEN_SQL + """, m AS (SELECT vec_id, dim, avg(v) AS m, stddev_pop(v) AS s FROM tok GROUP BY ALL), z AS (SELECT vec_id, list(m ORDER BY dim) AS m, list(s ORDER BY dim) AS s FROM m GROUP BY vec_id)
  SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS mean_0, round(s[4] / sqrt(list_dot_product(s, s)), 6) AS std_3, round(s[1] / sqrt(list_dot_product(m, m) + list_dot_product(s, s)), 6) AS both_4 FROM z""")
def e6(spark, d):
    p = G.pool_tokens(_tokens(spark, d), ["vec_id"])
    return p.select("vec_id", F.col("mean")[0].alias("mean_0"), F.col("std")[3].alias("std_3"), F.col("mean_std")[4].alias("both_4"))


@query("e7_pyramid_pool", TOKEN_SQL + """, l AS (SELECT vec_id, level, ("row" * level // 4) * level + (col * level // 4) AS block, dim, avg(v) AS m FROM tok, (SELECT unnest([2, 4]) AS level) GROUP BY ALL),
  z AS (SELECT vec_id, level, block, list(m ORDER BY dim) AS m FROM l GROUP BY ALL), u AS (SELECT vec_id, level, block, unnest(m) / sqrt(list_dot_product(m, m)) AS u, generate_subscripts(m, 1) AS k FROM z),
  f AS (SELECT vec_id, list(u ORDER BY level, block, k) AS p FROM u GROUP BY vec_id)
  SELECT vec_id, len(p) AS n, round(p[1], 6) AS first, round(p[16], 6) AS level2_last, round(p[80], 6) AS last FROM f""")
def e7(spark, d):
    p = G.pyramid_pool(_tokens(spark, d), ["vec_id"], 4)
    return p.select("vec_id", F.size("pyramid").alias("n"), F.col("pyramid")[0].alias("first"), F.col("pyramid")[15].alias("level2_last"), F.col("pyramid")[79].alias("last"))


COMMON_SQL = CELL_SQL + """, ok AS (SELECT gid, "row", col FROM plane GROUP BY ALL HAVING count(v) = count(*)), n AS (SELECT gid, count(*) AS common FROM ok GROUP BY gid HAVING count(*) >= 20),
  c AS (SELECT plane.*, common FROM plane JOIN ok USING (gid, "row", col) JOIN n USING (gid))"""


@query("e8_common_support_mean", COMMON_SQL + """, m AS (SELECT gid, vec_id, avg(v) AS support_mean, any_value(common) AS common FROM c GROUP BY ALL)
  SELECT gid, vec_id, round(support_mean, 6) AS support_mean, common, CAST(row_number() OVER (PARTITION BY gid ORDER BY support_mean, vec_id) = 1 AS BIGINT) AS is_pick FROM m""")
def e8(spark, d):
    return G.common_support_mean(_plane(spark, d), "gid", "vec_id")


@query("e9_cell_vote", COMMON_SQL + """, w AS (SELECT a.gid, a.vec_id, b.vec_id AS o, avg((a.v < b.v)::INT) AS s FROM c a JOIN c b ON a.gid = b.gid AND a."row" = b."row" AND a.col = b.col AND a.vec_id <> b.vec_id GROUP BY ALL),
  m AS (SELECT gid, vec_id, avg(s) AS vote FROM w GROUP BY ALL)
  SELECT gid, vec_id, round(vote, 6) AS vote, CAST(row_number() OVER (PARTITION BY gid ORDER BY round(vote, 9) DESC, vec_id) = 1 AS BIGINT) AS is_pick FROM m""")
def e9(spark, d):
    return G.cell_vote(_plane(spark, d), "gid", "vec_id")


@query("e10_saliency_moments", CELL_SQL + """, t AS (SELECT vec_id, sum(raw * raw) AS t FROM plane GROUP BY vec_id),
  m AS (SELECT vec_id, raw * raw / t AS m, (col + 0.5) / 8 AS x, ("row" + 0.5) / 8 AS y, "row", col FROM plane JOIN t USING (vec_id)),
  g AS (SELECT vec_id, sum(m * x) AS cx, sum(m * y) AS cy, sum(m * x * x) AS xx, sum(m * y * y) AS yy, sum(m * x * y) AS xy, sum(m) FILTER (y * 3 < 1 AND x * 3 < 1) AS third_0, sum(m) FILTER ("row" < 1) AS top, sum(m) FILTER (col >= 7) AS "right",
    -sum(m * ln(m)) / ln(64) AS entropy FROM m GROUP BY vec_id)
  SELECT vec_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(xx - cx * cx), 6) AS sx, round(sqrt(yy - cy * cy), 6) AS sy, round((xy - cx * cy) / (sqrt(xx - cx * cx) * sqrt(yy - cy * cy)), 6) AS corr,
    round(third_0, 6) AS third_0, round(top, 6) AS top, round("right", 6) AS "right", round(entropy, 6) AS entropy,
    round(least(sqrt((cx - 1.0/3)**2 + (cy - 1.0/3)**2), sqrt((cx - 1.0/3)**2 + (cy - 2.0/3)**2), sqrt((cx - 2.0/3)**2 + (cy - 1.0/3)**2), sqrt((cx - 2.0/3)**2 + (cy - 2.0/3)**2)), 6) AS to_third,
    round(sqrt((cx - 0.5)**2 + (cy - 0.5)**2), 6) AS to_centre, round(abs(cx - 0.5), 6) AS dx FROM g""")
def e10(spark, d):
    p = _plane(spark, d).select("vec_id", "row", "col", (F.col("raw") * F.col("raw")).alias("v"))
    return G.saliency_moments(p, ["vec_id"], 8).select("vec_id", "cx", "cy", "sx", "sy", "corr", "third_0", "top", "right", "entropy", "to_third", "to_centre", "dx")


@query("e11_boundary_stats", TOKEN_SQL + """, z AS (SELECT vec_id, "row", col, list(v ORDER BY dim) AS v FROM tok GROUP BY ALL), u AS (SELECT vec_id, "row", col, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM z),
  h AS (SELECT a.vec_id, a."row", a.col, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.vec_id = b.vec_id AND a."row" = b."row" AND b.col = a.col + 1),
  w AS (SELECT a.vec_id, a."row", a.col, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.col = b.col AND b."row" = a."row" + 1),
  re AS (SELECT vec_id, "row" AS k, avg(1 - s) AS e FROM w GROUP BY ALL), ce AS (SELECT vec_id, col AS k, avg(1 - s) AS e FROM h GROUP BY ALL),
  cell AS (SELECT vec_id, "row", col, avg(e) AS e FROM (SELECT vec_id, "row", col, 1 - s AS e FROM h UNION ALL SELECT vec_id, "row", col + 1, 1 - s FROM h UNION ALL SELECT vec_id, "row", col, 1 - s FROM w UNION ALL SELECT vec_id, "row" + 1, col, 1 - s FROM w) GROUP BY ALL),
  mx AS (SELECT a.vec_id, avg(list_dot_product(a.u, b.u)) AS s FROM u a JOIN u b ON a.vec_id = b.vec_id AND a."row" = b."row" AND b.col = 3 - a.col AND a.col < 2 GROUP BY a.vec_id),
  my AS (SELECT a.vec_id, avg(list_dot_product(a.u, b.u)) AS s FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.col = b.col AND b."row" = 3 - a."row" AND a."row" < 2 GROUP BY a.vec_id)
  SELECT mx.vec_id, round(((SELECT avg(s) FROM h WHERE h.vec_id = mx.vec_id) + (SELECT avg(s) FROM w WHERE w.vec_id = mx.vec_id)) / 2, 6) AS coherence,
    round((SELECT (arg_max(k, e) + 1) / 4 FROM re WHERE re.vec_id = mx.vec_id), 6) AS row_line, round((SELECT max(e) / avg(e) FROM re WHERE re.vec_id = mx.vec_id), 6) AS row_strength,
    round((SELECT (arg_max(k, e) + 1) / 4 FROM ce WHERE ce.vec_id = mx.vec_id), 6) AS col_line, round((SELECT max(e) / avg(e) FROM ce WHERE ce.vec_id = mx.vec_id), 6) AS col_strength,
    round((SELECT avg(e) FROM cell WHERE cell.vec_id = mx.vec_id AND ("row" IN (0, 3) OR col IN (0, 3))), 6) AS border, round((SELECT avg(e) FROM cell WHERE cell.vec_id = mx.vec_id AND "row" IN (1, 2) AND col IN (1, 2)), 6) AS interior,
    round(mx.s, 6) AS mirror_x, round(my.s, 6) AS mirror_y FROM mx JOIN my USING (vec_id)""")
def e11(spark, d):
    t = _tokens(spark, d).groupBy("vec_id", "row", "col").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("z"))
    return G.boundary_stats(t.select("vec_id", "row", "col", V.l2_normalize(F.col("z.v")).alias("u")), ["vec_id"], 4)


@query("e12_descriptor_reliability", """WITH q AS (SELECT *, row_number() OVER (PARTITION BY event, owner, seg ORDER BY t, id) AS pos FROM scored),
  p AS (SELECT a.score_a AS a1, b.score_a AS a2, a.score_b AS b1, b.score_b AS b2, a.value AS v1, b.value AS v2 FROM q a JOIN q b ON a.event = b.event AND a.owner = b.owner AND a.seg = b.seg AND b.pos = a.pos + 1),
  r AS (SELECT 'score_a' AS descriptor, corr(a1, a2) AS r FROM p UNION ALL SELECT 'score_b', corr(b1, b2) FROM p UNION ALL SELECT 'value', corr(v1, v2) FROM p)
  SELECT descriptor, round(r, 6) AS r FROM r UNION ALL SELECT 'median', round(quantile_cont(r, 0.5), 6) FROM r""")
def e12(spark, d):
    names = ["score_a", "score_b", "value"]
    p = T.lag_pairs(views.with_scores(views.shots(spark, d)), SEGMENT, "t", 1, names)
    return G.descriptor_reliability(p, names)


@query("e13_tilt_peak", """WITH p AS (SELECT l_suppkey, CAST(floor(((l_extendedprice + 45) - 90 * floor((l_extendedprice + 45) / 90)) / 0.05) AS BIGINT) % 1800 AS b, l_quantity AS w FROM lineitem),
  h AS (SELECT l_suppkey, b, sum(w) AS w, count(*) AS c FROM p GROUP BY ALL), n AS (SELECT l_suppkey, sum(c)::BIGINT AS n_edge, sum(w) AS t FROM h GROUP BY l_suppkey),
  k AS (SELECT k, exp(-0.5 * (k / 1.5::DOUBLE) ** 2) AS t FROM range(-3, 4) r(k)), kn AS (SELECT k, t / sum(t) OVER () AS t FROM k),
  s AS (SELECT l_suppkey, (b + k + 1800) % 1800 AS b, sum(w * t) AS y FROM h, kn GROUP BY 1, 2),
  m AS (SELECT l_suppkey, b AS pk, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(y, 9) DESC, b) AS r FROM s),
  z AS (SELECT m.l_suppkey, pk, coalesce(max(y) FILTER (s.b = (pk + 1799) % 1800), 0) AS y0, max(y) FILTER (s.b = pk) AS y1, coalesce(max(y) FILTER (s.b = (pk + 1) % 1800), 0) AS y2 FROM m JOIN s USING (l_suppkey) WHERE r = 1 GROUP BY ALL)
  SELECT l_suppkey, CASE WHEN n_edge >= 300 THEN round((pk + CASE WHEN abs(y0 - 2 * y1 + y2) > 1e-12 THEN 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2) ELSE 0 END) * 0.05 - 45, 6) END AS tilt_deg, CASE WHEN n_edge >= 300 THEN round(y1 / t, 6) END AS conf, n_edge FROM z JOIN n USING (l_suppkey)""")
def e13(spark, d):
    return G.tilt_peak(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query("e14_tilt_crosscheck", """WITH x AS (SELECT floor, (l_extendedprice - l_quantity + 45) - 90 * floor((l_extendedprice - l_quantity + 45) / 90) - 45 AS r FROM lineitem, (SELECT unnest([0.0::DOUBLE, 0.05::DOUBLE]) AS floor) WHERE l_discount >= floor),
  m AS (SELECT floor, quantile_cont(r, 0.5) AS med FROM x GROUP BY floor)
  SELECT x.floor, count(*) AS n, round(avg(r), 6) AS mean, round(any_value(med), 6) AS median, round(quantile_cont(abs(r - med), 0.5), 6) AS mad, round(stddev_pop(r), 6) AS std, round(quantile_cont(abs(r), 0.5), 6) AS abs_p50, round(quantile_cont(abs(r), 0.9), 6) AS abs_p90
  FROM x JOIN m USING (floor) GROUP BY x.floor""")
def e14(spark, d):
    return G.tilt_crosscheck(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", [0.0, 0.05])


@query("e15_mask_components", """WITH RECURSIVE k AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, i FROM vectors, range(1, 65) g(i) WHERE v[i] > 0.05),
  x AS (SELECT vec_id, r, c, i AS root FROM k UNION SELECT k.vec_id, k.r, k.c, x.root FROM x JOIN k ON k.vec_id = x.vec_id AND abs(k.r - x.r) + abs(k.c - x.c) = 1),
  m AS (SELECT vec_id, r, c, min(root) AS root FROM x GROUP BY ALL), b AS (SELECT vec_id, root, count(*) AS n, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM m GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, root) AS p, count(*) OVER (PARTITION BY vec_id) AS blobs, sum(n) OVER (PARTITION BY vec_id) AS t FROM b)
  SELECT vec_id, blobs, round(n / t, 6) AS largest_share, round(w / 8, 6) AS box_w, round(h / 8, 6) AS box_h FROM o WHERE p = 1""")
def e15(spark, d):
    return G.mask_components(_plane(spark, d).where("raw > 0.05"), ["vec_id"], 8)


@query("e16_assemble_channels", CELL_SQL + """ SELECT e.vec_id, "row", col, CAST(label AS DOUBLE) AS scalar, round(coalesce(max(c.v) FILTER (c.scalar = 0), 0), 6) AS ch_0, round(coalesce(max(c.v) FILTER (c.scalar = 3), 0), 6) AS ch_3, round(avg((c.v IS NULL)::INT), 6) AS missing
  FROM vectors e JOIN cells c ON c.vec_id = e.vec_id AND e.vec_id % 3 <> 0 GROUP BY ALL
  UNION ALL SELECT vec_id, r, c, CAST(label AS DOUBLE), 0.0, 0.0, 1.0 FROM vectors, range(0, 4) a(r), range(0, 4) b(c) WHERE vec_id % 3 = 0""")
def e16(spark, d):
    items = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("scalar"))
    cells = _cells(spark, d).where("vec_id % 3 <> 0")
    return G.assemble_channels(items, cells, "vec_id", ["scalar"], 4, 4).select("vec_id", "row", "col", "scalar", "ch_0", "ch_3", "missing")


@query("v9_compare_vectors", """WITH a AS (SELECT vec_id, v, list_transform(v, lambda x, i: CASE WHEN vec_id % 4 = 0 THEN x ELSE x + 0.001 * (i % 3) END) AS w FROM vectors),
  d AS (SELECT vec_id, list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w))) AS c, list_max(list_transform(v, lambda x, i: abs(x - w[i]))) AS mx, list_sum(list_transform(v, lambda x, i: abs(x - w[i]))) AS sm, v = w AS eq FROM a)
  SELECT count(*) AS items, round(min(c), 6) AS cos_min, round(avg(c), 6) AS cos_mean, round(max(mx), 6) AS max_abs, round(sum(sm) / (count(*) * 64), 6) AS mean_abs, count(*) FILTER (eq) AS equal_items FROM d""")
def v9(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    b = a.select("vec_id", F.transform("v", lambda x, i: F.when(F.col("vec_id") % 4 == 0, x).otherwise(x + 0.001 * ((i + 1) % 3))).alias("v"))
    return V.compare_vectors(a, b, "vec_id", "v")


@query("v9_compare_grids", CELL_SQL + """ SELECT scalar, count(*) AS cells, count(*) FILTER (v IS NULL) AS mask_diff, CASE WHEN count(v) > 0 THEN 0.0::DOUBLE END AS max_abs, CASE WHEN count(v) > 0 THEN 0.0::DOUBLE END AS mean_abs FROM cells GROUP BY scalar""")
def v9_grids(spark, d):
    a = _nan_grid(spark, d)
    b = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("grid"))
    return V.compare_grids(a, b, "vec_id", "grid", 16)


@query("u3_score_batches", """SELECT vec_id, round(-list_sum(v), 6) AS score FROM vectors""")
def u3(spark, d):
    def make_predict():
        def predict(x):
            return x.sum(axis=1)

        return predict

    return V.score_batches(table(spark, d, "embeddings"), "vec_id", "embedding", make_predict, 64, lower_is_better=True)
