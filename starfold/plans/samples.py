"""Queries of samplers (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.core import hash_int
from starfold.operators import sampling as Q
from starfold.operators.clusters import representatives
from starfold.plans import views
from starfold.plans.registry import query
from starfold.plans.reports import MIX_SQL, _mixed
from starfold.plans.views import CLUSTER, SEGMENT


@query("q1_largest_remainder", """WITH c AS (SELECT owner, count(*) AS n FROM items GROUP BY owner), r AS (SELECT owner, 777 * (n / (SELECT sum(n) FROM c)) AS raw FROM c), b AS (SELECT owner, raw, floor(round(raw, 9)) AS base FROM r),
  k AS (SELECT *, row_number() OVER (ORDER BY round(raw - base, 9) DESC, owner) AS rn FROM b) SELECT owner, CAST(base + (rn <= 777 - (SELECT sum(base) FROM b))::INT AS BIGINT) AS quota FROM k""")
def q1(spark, d):
    c = views.items(spark, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    w = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("owner", (F.col("n") / F.col("t")).alias("w"))  # one row
    return Q.largest_remainder(w, "owner", "w", 777).select("owner", "quota")


QUOTA_SQL = """qc AS (SELECT {e} AS e, count(*) AS n FROM {t} GROUP BY 1), qm AS (SELECT *, least({m}, n) AS mn FROM qc), qs AS (SELECT sum(mn) AS used, sum(n - mn) AS ex FROM qm),
  qr AS (SELECT e, n, mn, greatest({total} - used, 0) AS lft, greatest({total} - used, 0) * coalesce((n - mn) / nullif(ex, 0), 0) AS raw FROM qm, qs), qb AS (SELECT *, floor(round(raw, 9)) AS base FROM qr),
  qk AS (SELECT *, row_number() OVER (ORDER BY round(raw - base, 9) DESC, e) AS rn, sum(base) OVER () AS sb FROM qb), qq AS (SELECT e, n, CAST(mn + base + (rn <= lft - sb)::INT AS BIGINT) AS quota FROM qk)"""


@query("q1_quotas", "WITH " + QUOTA_SQL.format(e="owner", t="items WHERE star >= 3", m=3, total=600) + " SELECT e AS owner, n, quota FROM qq")
def q1_quotas(spark, d):
    c = views.items(spark, d).where("star >= 3").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return Q.quotas(c, "owner", "n", 600, 3)


RR_SQL = """rh AS (SELECT *, event || '|' || owner || '|' || seg AS sn, row_number() OVER (PARTITION BY {part} ORDER BY {first} {h}, id) AS rnd, count(*) OVER (PARTITION BY {part}) AS sz FROM {t}),
  rr AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rnd, sz DESC, sn) AS rr FROM rh)"""


@query("q2_round_robin", "WITH " + RR_SQL.format(part="event, owner, seg", first="", h="{hash:rr:id}", t="shots", by="event") + " SELECT event, id, rr FROM rr WHERE rr <= 100")
def q2(spark, d):
    return Q.round_robin(views.shots(spark, d), "event", SEGMENT, "id", "rr").where("rr <= 100").select("event", "id", "rr")


@query("q3_stratified_sample", "WITH " + QUOTA_SQL.format(e="event", t="shots WHERE star >= 3", m=8, total=200) + """,
  sw AS (SELECT e, r, sh, quota, quota * sh AS raw, floor(round(quota * sh, 9)) AS base FROM qq, (SELECT unnest([3, 4, 5]) AS r, unnest([0.53::DOUBLE, 0.27::DOUBLE, 0.2::DOUBLE]) AS sh)),
  sk AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(raw - base, 9) DESC, r) AS rn, sum(base) OVER (PARTITION BY e) AS sb FROM sw), sx AS (SELECT e, r, quota, base + (rn <= quota - sb)::INT AS want FROM sk),
  sh AS (SELECT sx.*, coalesce(n, 0) AS have, least(want, coalesce(n, 0)) AS t0 FROM sx LEFT JOIN (SELECT event, star, count(*) AS n FROM shots GROUP BY ALL) c ON c.event = e AND c.star = r),
  sy AS (SELECT *, quota - sum(t0) OVER (PARTITION BY e) AS short, coalesce(sum(have - t0) OVER (PARTITION BY e ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given FROM sh),
  st AS (SELECT e, r, t0 + greatest(0, least(have - t0, short - given)) AS take FROM sy), """ + RR_SQL.format(part="event, owner, seg, star", first="", h="{hash:strat:id}", t="(SELECT * FROM shots WHERE star >= 3)", by="event, star") + """
  SELECT id, event, CAST(star AS BIGINT) AS star FROM rr JOIN st ON e = event AND r = star WHERE rr <= take""")
def q3(spark, d):
    return Q.stratified_sample(views.shots(spark, d), "event", SEGMENT, "id", "star", 200, 8).select("id", "event", "star")


@query("q4_pair_strata")
def q4(spark, d):
    return Q.pair_strata(views.shots(spark, d), "id", "star", "event", SEGMENT, 120)


@query("q5_representative_pool", """WITH u AS (SELECT id FROM items WHERE id % 40 = 0), z AS (SELECT *, id IN (SELECT id FROM u) AS used FROM scored),
  r1 AS (SELECT arg_max(id, round(score_b * 1e9) * 100000000 + id) AS id, 1 AS p, 'big_cluster_top' AS role FROM z WHERE cluster_size >= 4 AND is_top = 1 GROUP BY event, owner, cluster HAVING NOT bool_or(used)),
  r2 AS (SELECT id, 2, 'isolated_high' FROM z WHERE cluster_size = 1 AND NOT used AND star >= 3), lo AS (SELECT event, id, row_number() OVER (PARTITION BY event ORDER BY {hash:pool:id}, id) AS pos, count(*) OVER (PARTITION BY event) AS n, count(*) OVER () AS t FROM z WHERE cluster_size = 1 AND NOT used AND star <= 2),
  r3 AS (SELECT id, 3, 'isolated_low' FROM lo WHERE pos <= least(n, greatest(1, round_even(100 * n / t, 0)))), sg AS (SELECT event, owner, seg, count(*) AS n, max(star) AS cap FROM z GROUP BY ALL),
  r4 AS (SELECT arg_max(id, round(score_b * 1e9) * 100000000 + id), 4, 'seg_top' FROM z JOIN sg USING (event, owner, seg) WHERE (sg.n < 2 OR cap <= 1) AND NOT used AND star = cap GROUP BY event, owner, seg),
  al AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4) SELECT id, first(role ORDER BY p) AS role FROM al GROUP BY id""")
def q5(spark, d):
    z = views.with_scores(views.clustered(spark, d))
    return Q.representative_pool(z, "event", SEGMENT, CLUSTER, "id", "star", "score_b", z.where("id % 40 = 0").select("id"), 4, 100, 2, 1)


@query("q6_coverage_pool", """WITH sg AS (SELECT event, owner, seg, count(*) AS n, max(star) AS cap, first(id ORDER BY star DESC, score_b DESC, id DESC) AS top FROM scored GROUP BY ALL), sn AS (SELECT event, count(*) AS segs FROM sg GROUP BY event),
  qt AS (SELECT event, CAST(greatest(15, least(20, round_even(90 * segs / (SELECT sum(segs) FROM sn), 0))) AS BIGINT) AS quota FROM sn),
  d AS (SELECT s.*, CASE WHEN id = top AND (n < 8 OR cap <= 2) THEN 0 WHEN id = top AND cluster_size >= 5 AND is_top = 1 THEN 1 WHEN id = top AND cluster_size = 1 AND star >= 3 THEN 2 WHEN id = top THEN 3 WHEN cluster_size >= 5 AND is_top = 1 THEN 4 WHEN cluster_size = 1 AND star >= 3 THEN 5 WHEN cluster_size = 1 AND star <= 2 THEN 6 END AS rule FROM scored s JOIN sg USING (event, owner, seg)),
  p AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY rule, {hash:cover:id}, id) AS pos FROM d WHERE rule IS NOT NULL)
  SELECT p.event, owner, seg, id, CASE WHEN rule IN (0, 3) THEN 'seg_top' WHEN rule IN (1, 4) THEN 'big_cluster_top' WHEN rule IN (2, 5) THEN 'isolated_high' ELSE 'isolated_low' END AS role, quota FROM p JOIN qt USING (event) WHERE pos <= quota""")
def q6(spark, d):
    z = views.with_scores(views.clustered(spark, d))
    return Q.coverage_pool(z, "event", SEGMENT, "id", "star", "score_b", 90, big=5)


@query("q7_hidden_duplicates", """WITH pk AS (SELECT id FROM items), od AS (SELECT id, row_number() OVER (ORDER BY {hash:dup-pick:id}, id) AS p FROM pk),
  b AS (SELECT id, 0 AS dp FROM pk UNION ALL SELECT id, 1 FROM od WHERE p <= greatest(1, round_even((SELECT count(*) FROM pk) * 0.12, 0))), k AS (SELECT *, id || '#' || dp AS kk FROM b)
  SELECT 'C' || lpad((row_number() OVER (ORDER BY {hash:dup:kk}, kk))::VARCHAR, 6, '0') AS new_name, id, CASE WHEN dp = 1 THEN id END AS is_dup_of FROM k""")
def q7(spark, d):
    return Q.hidden_duplicates(views.items(spark, d).select("id"), "id", 0.12, "C")


CL_SQL = """cc AS (SELECT event, owner, seg, event || '/' || owner || '/' || cluster AS cl, count(*) AS n, CASE WHEN max(star) - min(star) >= 2 THEN 'd2p' WHEN max(star) - min(star) = 1 THEN 'd1' ELSE 'same' END AS bucket FROM scored GROUP BY event, owner, seg, cluster HAVING count(*) >= 2)"""


def _cluster_frame(spark, d):
    z = views.with_scores(views.shots(spark, d)).withColumn("cl", F.concat_ws("/", "event", F.col("owner").cast("string"), F.col("cluster").cast("string")))
    g = z.groupBy("event", "owner", "seg", "cl").agg(F.count(F.lit(1)).alias("n"), (F.max("star") - F.min("star")).alias("gap")).where("n >= 2")
    return z, g.select("event", "owner", "seg", "cl", "n", F.when(F.col("gap") >= 2, "d2p").when(F.col("gap") == 1, "d1").otherwise("same").alias("bucket"))


@query("q8_cluster_exam", "WITH " + CL_SQL + """, a AS (SELECT *, {hash:exam:cl} AS h, row_number() OVER (PARTITION BY event, owner, seg ORDER BY {hash:exam:cl}, cl) AS s FROM cc), b AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY h, cl) AS e FROM a WHERE s <= 1),
  f AS (SELECT event, greatest(4, round_even(80 * count(*) / (SELECT count(*) FROM cc) * 1.5, 0)) AS soft FROM cc GROUP BY event), c AS (SELECT b.*, CASE WHEN e <= soft THEN 1 ELSE 2 END AS pass FROM b JOIN f USING (event)),
  q AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pass, h, cl) AS q FROM c) SELECT event, owner, seg, cl, n, bucket, CAST(pass AS BIGINT) AS pass FROM q WHERE q <= CASE bucket WHEN 'd2p' THEN 40 WHEN 'd1' THEN 30 ELSE 10 END""")
def q8(spark, d):
    return Q.cluster_exam(_cluster_frame(spark, d)[1], "event", SEGMENT, "cl", "bucket", {"d2p": 40, "d1": 30, "same": 10}, 1)


@query("q9_band_exam", """WITH v AS (SELECT *, event || '/' || owner || '/' || cluster AS cl, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, {hash:cl:id} % 1000 / 1000.0::DOUBLE AS lat FROM vshots),
  pc AS (SELECT a.cl, avg(list_dot_product(a.u, b.u)) AS cos FROM v a JOIN v b ON a.cl = b.cl AND a.id < b.id GROUP BY a.cl), md AS (SELECT cl, lat AS mid FROM (SELECT cl, lat, row_number() OVER (PARTITION BY cl ORDER BY lat, id) AS r, count(*) OVER (PARTITION BY cl) AS n FROM v) WHERE n >= 2 AND r = n // 2 + 1),
  cd AS (SELECT event, owner, any_value(seg) AS seg, cl, any_value(cos) AS cos, any_value((SELECT count(*) FROM v x WHERE x.lat < mid) / (SELECT count(*) FROM v)) AS lat_q, CASE WHEN owner % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM v JOIN pc USING (cl) JOIN md USING (cl) GROUP BY event, owner, cl),
  a AS (SELECT *, {hash:band:cl} AS h, (cos >= 0.05)::INT AS hi, CASE WHEN split = 'test' THEN 'exam' WHEN lat_q >= 0.67 THEN 'train_top' WHEN lat_q >= 0.33 THEN 'train_mid' ELSE 'train_bot' END AS band FROM cd), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY event, owner, seg ORDER BY h, cl) <= 1),
  c AS (SELECT * FROM b QUALIFY hi = 0 OR row_number() OVER (PARTITION BY band, hi ORDER BY h, cl) <= CASE band WHEN 'exam' THEN 15 WHEN 'train_top' THEN 12 WHEN 'train_mid' THEN 8 ELSE 4 END)
  SELECT event, owner, seg, cl, round(cos, 6) AS cos, round(lat_q, 6) AS lat_q, split, band FROM c QUALIFY row_number() OVER (PARTITION BY band ORDER BY CASE WHEN band = 'exam' THEN CASE WHEN hi = 1 THEN -1.0 ELSE 1 - lat_q END ELSE h / 4294967296.0 END, h, cl) <= CASE band WHEN 'exam' THEN 40 WHEN 'train_top' THEN 30 WHEN 'train_mid' THEN 20 ELSE 10 END""")
def q9(spark, d):
    z = views.with_vectors(spark, d, views.shots(spark, d)).withColumn("lat", (hash_int("cl", "id") % 1000) / 1000.0)
    z = z.withColumn("cl", F.concat_ws("/", "event", F.col("owner").cast("string"), F.col("cluster").cast("string")))
    cards = Q.cluster_cards(z, ["event", "owner", "seg", "cl"], "id", "v", "lat", "star").drop("size", "mid")
    cards = cards.withColumn("split", F.when(F.col("owner") % 4 == 0, "test").otherwise("train"))
    return Q.band_exam(cards, SEGMENT, "cl", "split", {"top": 30, "mid": 20, "bot": 10}, 40, 0.05, 0.4, 15, 1)


@query("q10_trim_members", """WITH g AS (SELECT owner, id, is_top, score_b, count(*) OVER (PARTITION BY event, owner) AS n, count(*) FILTER (is_top = 1) OVER (PARTITION BY event, owner) AS t, event FROM (SELECT event, owner, id, score_b, CASE WHEN star >= 5 THEN 1 ELSE 0 END AS is_top FROM scored)),
  r AS (SELECT *, row_number() OVER (PARTITION BY event, owner ORDER BY is_top DESC, score_b DESC, id) AS r, greatest(1, (n - t) // 5) AS st FROM g)
  SELECT event, owner, id FROM r WHERE n <= 6 OR (is_top = 1 AND r <= 6) OR (is_top = 0 AND (r - t - 1) % st = 0 AND (r - t - 1) // st < 6 - t)""")
def q10(spark, d):
    z = views.with_scores(views.items(spark, d)).withColumn("is_top", (F.col("star") >= 5).cast("int"))
    return Q.trim_members(z, ["event", "owner"], "id", "is_top", "score_b").select("event", "owner", "id")


@query("q11_anonymise", """WITH g AS (SELECT gid, 'R' || lpad((row_number() OVER (ORDER BY {hash:anon:gid}, gid))::VARCHAR, 6, '0') AS r_gid FROM (SELECT DISTINCT gid FROM exam))
  SELECT r_gid, chr((64 + row_number() OVER (PARTITION BY gid ORDER BY {hash:anon-slot:gid,id}, id))::INTEGER) AS r_anon, gid, id FROM exam JOIN g USING (gid)""")
def q11(spark, d):
    return Q.anonymise(views.exam(spark, d), "gid", "id")


def _mixed_groups(spark, d):
    z = views.with_scores(views.shots(spark, d)).withColumn("cl", F.concat_ws("/", "event", F.col("owner").cast("string"), F.col("cluster").cast("string")))
    reps = representatives(z, "event", "cl", "id", "score_a", "score_a").select("event", "id")
    return z, Q.mixed_groups(reps.join(z.select("id", "score_a", "score_b"), "id"), "event", "id", "score_a", "score_b", 8)


@query("q12_mixed_groups")
def q12(spark, d):
    return _mixed_groups(spark, d)[1]


@query("q13_comparison_tasks")
def q13(spark, d):
    z, g = _mixed_groups(spark, d)
    return Q.comparison_tasks(g.join(z.select("id", "score_a", "score_b"), "id"), "event", "grp", "id", "score_a", "score_b", 30)


@query("q14_active_draw", "WITH " + RR_SQL.format(part="event, owner, seg", first="is_top DESC,", h="{hash:active:id}", t="clustered", by="event") + """ SELECT 'active' AS mode, event, id FROM rr WHERE rr <= 50
  UNION ALL SELECT 'random', event, id FROM (SELECT event, id, row_number() OVER (PARTITION BY event ORDER BY {hash:active:id}, id) AS r FROM items) WHERE r <= 50""")
def q14(spark, d):
    c = views.clustered(spark, d)
    a = Q.active_draw(c, "event", SEGMENT, "id", 50, "active").select(F.lit("active").alias("mode"), "event", "id")
    return a.unionByName(Q.active_draw(c, "event", SEGMENT, "id", 50, "random").select(F.lit("random").alias("mode"), "event", "id"))


@query("q15_balanced_batches", "WITH " + MIX_SQL + """, k AS (SELECT DISTINCT source, event, grp, winner || '>' || loser AS pk FROM mx), e AS (SELECT source, event, row_number() OVER (PARTITION BY source ORDER BY {hash:batch:event}, event) AS ei, count(*) OVER (PARTITION BY source) AS en FROM (SELECT DISTINCT source, event FROM k)),
  g AS (SELECT source, event, grp, row_number() OVER (PARTITION BY source, event ORDER BY {hash:batch:grp}, grp) AS gi, count(*) OVER (PARTITION BY source, event) AS gn FROM (SELECT DISTINCT source, event, grp FROM k)),
  p AS (SELECT *, row_number() OVER (PARTITION BY source, event, grp ORDER BY {hash:batch:pk}, pk) AS pi, count(*) OVER (PARTITION BY source, event, grp) AS pn FROM k), s AS (SELECT i, i // 16 AS batch, i % 16 AS slot, CASE WHEN i % 16 < 4 THEN 'golden' ELSE 'window' END AS source FROM range(0, 3200) r(i)),
  a AS (SELECT s.*, e.event FROM s JOIN e ON e.source = s.source AND e.ei = {hash:batch-e:i} % e.en + 1), b AS (SELECT a.*, g.grp FROM a JOIN g ON g.source = a.source AND g.event = a.event AND g.gi = {hash:batch-g:i} % g.gn + 1)
  SELECT batch, slot, b.source, b.event, b.grp, p.pk FROM b JOIN p ON p.source = b.source AND p.event = b.event AND p.grp = b.grp AND p.pi = {hash:batch-p:i} % p.pn + 1""")
def q15(spark, d):
    k = _mixed(spark, d).select("source", "event", F.col("group").alias("grp"), F.concat_ws(">", "winner", "loser").alias("pk")).distinct()
    return Q.balanced_batches(k, "source", "event", "grp", "pk", 200, 16, {"golden": 4, "window": 12})


@query("q16_event_subsets", """WITH e AS (SELECT owner, draw, row_number() OVER (PARTITION BY draw ORDER BY {hash:subset:draw,owner}, owner) AS pos FROM (SELECT DISTINCT owner FROM items), range(0, 3) d(draw))
  SELECT h.owner AS held_out, size, h.draw, t.owner FROM e h, (SELECT unnest([2::BIGINT, 5]) AS size) s, e t WHERE t.draw = h.draw AND t.owner <> h.owner AND t.pos <= size + (h.pos <= size)::INT""")
def q16(spark, d):
    return Q.event_subsets(views.items(spark, d), "owner", [2, 5], 3)

