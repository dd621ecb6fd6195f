"""Similarity joins, graph components and column functions on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.functions import grids as G
from starfold.functions import scalars as S
from starfold.functions import vectors as V
from starfold.operators import clusters as C
from starfold.operators import joins as J


@pytest.mark.parametrize("threshold,by", [(0.9, ["g"]), (0.4, ["g"]), (0.8, [])])
def test_blocked_similarity_equals_brute_force(spark, threshold, by):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    x = centres[rng.integers(0, 5, 260)] + rng.normal(size=(260, 16)) * 0.4
    g = ["hot" if i % 3 else f"s{i % 5}" for i in range(260)]
    d = spark.createDataFrame([(i, g[i], [float(v) for v in x[i]]) for i in range(260)], "id long, g string, v array<double>")
    got = {(r["id_i"], r["id_j"]) for r in V.similarity_pairs(d, "id", "v", threshold, by=by, rows_per_block=13, small_group=10).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(260) for j in range(i + 1, 260) if u[i] @ u[j] >= threshold and (not by or g[i] == g[j])}
    assert got == want and want


def test_cross_class_pairs_split_large_classes(spark):
    d = spark.createDataFrame([(i, 0, i % 4) for i in range(120)], "id long, g int, c int")
    got = {(r["id_i"], r["id_j"]) for r in J.cross_class_pairs(d, "g", "id", "c", [], rows_per_block=7).collect()}
    assert got == {(i, j) for i in range(120) for j in range(120) if i % 4 > j % 4}


def test_cross_class_pairs_of_two_large_classes_are_many_tasks(spark):
    d = spark.range(400).groupBy("id").agg(F.max(F.col("id") % 1).alias("g"), F.max(F.col("id") % 2).cast("int").alias("c"))
    p = J.cross_class_pairs(d, "g", "id", "c", [], rows_per_block=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = [r[1] for r in p.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(tasks) == 200 * 200 and max(tasks) < 200 * 200 * 0.6


def _components(edges, n):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(i * 7 % 61, i * 13 % 61) for i in range(30)], []])
def test_components(spark, edges):
    e = spark.createDataFrame(edges or [(0, 0)], "src long, dst long")
    got = {r["id"]: r["component"] for r in C.connected_components(e, spark.range(61)).collect()}
    assert [got[i] for i in range(61)] == _components(edges, 61)


def test_normalise_zero_vector_and_decode(spark):
    d = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in d.select(V.l2_normalize(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]
    b = spark.createDataFrame([(bytearray(np.array([1, 2.5], "<f4").tobytes()),), (bytearray(b"abc"),), (None,)], "b binary")
    assert [r[0] for r in b.select(V.decode_f32(2)(F.col("b"))).collect()] == [[1.0, 2.5], None, None]


def test_distance_skips_missing_parts(spark):
    d = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    p = spark.createDataFrame([(1.0, 3.0, None, None), (None, 1.0, None, 2.0)], "a_i double, a_j double, b_i double, b_j double")
    got = [r["cv_dist"] for r in V.scalar_distance(p, V.scale_frame(d, ["a", "b"]), ["a", "b"]).collect()]
    assert got == [2.0, None]


def test_nan_cells_and_all_missing_grid(spark):
    nan = float("nan")
    d = spark.createDataFrame([(1, [1.0, nan, 3.0, 5.0]), (2, [nan] * 4)], "id int, g array<double>")
    r = {x["id"]: x for x in G.grid_stats(G.cells(d, ["id"], "g", 2), ["id"]).collect()}
    assert r[1]["mean"] == 3.0 and r[1]["min"] == 1.0 and r[1]["missing"] == 0 and r[2]["missing"] == 1 and r[2]["mean"] is None


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert math.isclose(get(S.piecewise_weight(F.lit(0.852))), 0.65) and get(S.piecewise_weight(F.lit(0.5))) == 0.0
    assert get(S.fold_angle(F.lit(45.0))) == -45.0 and get(S.fold_angle(F.lit(-46.0))) == 44.0
    assert get(S.parse_time(F.lit("2024-02-12T10:00:00"), F.lit("5"))).microsecond == 500000
    assert get(S.parse_time(F.lit("nonsense"), F.lit(None).cast("string"))) is None
    assert get(S.strip_export_suffix(F.lit("DSC1@jpg_12.JPG"))) == "DSC1"
    assert get(S.extract_rating(F.lit("<xmp:Rating>-1</xmp:Rating>"), F.lit(None).cast("string"))) == 0
    assert get(S.mask_attribute(F.lit('a xmp:Rating="4" <xmp:Rating>3</xmp:Rating>'))) == 'a xmp:Rating="0" <xmp:Rating>0</xmp:Rating>'
    p = get(S.tilt_probabilities(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]), F.lit(2.0), 0.0))
    assert np.allclose(p, [0.1, 0.2, 0.3, 0.4])
    event, blank = S.normalise_event(F.lit(""), "old")
    assert get(event) == "old" and get(blank) is True


def test_cell_vote_needs_an_opponent(spark):
    rows = [(g, m, k // 8, k % 8, (m * 7 + k) % 5 * 0.1) for g, m in ((0, 1), (0, 2), (1, 3)) for k in range(64)]
    got = G.cell_vote(spark.createDataFrame(rows, "gid long, id long, row int, col int, v double"), "gid", "id").collect()
    assert {r["id"] for r in got} == {1, 2} and sum(r["is_pick"] for r in got) == 1


def test_strips_counts_quantiles_and_differing_groups_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(230, 8)) + 0.3
    g = ["hot" if i % 3 else f"s{i % 9}" for i in range(230)]
    d = spark.createDataFrame([(i, g[i], [float(v) for v in x[i]]) for i in range(230)], "id long, g string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    inside = np.array([u[i] @ u[j] for i in range(230) for j in range(i + 1, 230) if g[i] == g[j]])
    cut = {"by": "g", "rows_per_block": 11, "rows_per_strip": 40, "small_group": 30}
    got = V.similarity_pairs(d, "id", "v", -1.0, **cut).collect()
    assert len(got) == len({(r["id_i"], r["id_j"]) for r in got}) == len(inside) and all(r["id_i"] < r["id_j"] for r in got)
    counts = {r["k"]: r["pairs"] for r in V.similarity_counts(d, "id", "v", [0.1, 0.5], **cut).collect()}
    assert [counts[k] for k in range(3)] == [(inside < 0.1).sum(), ((inside >= 0.1) & (inside < 0.5)).sum(), (inside >= 0.5).sum()]
    ps = {"a": 0.0, "b": 0.37, "c": 0.98, "d": 1.0}
    q = V.similarity_quantiles(d, "id", "v", ps, bins=32, **cut).first()
    assert list(q) == pytest.approx(list(np.quantile(inside, list(ps.values()))), abs=1e-12)
    pairs = {(r["id_i"], r["id_j"]) for r in V.cross_group_pairs(d, "id", "v", "g", 0.4, rows_per_strip=40).collect() if (r["group_i"], r["group_j"]) == (g[r["id_i"]], g[r["id_j"]])}
    assert pairs == {(i, j) for i in range(230) for j in range(i + 1, 230) if g[i] != g[j] and u[i] @ u[j] >= 0.4}


def test_tilt_peak_does_not_shuffle_smoothed_bins(spark):
    d = spark.createDataFrame([(g, (k % 40) * 0.05, 1.0) for g in range(3) for k in range(400)], "id long, a double, w double")
    exchanges = [x for x in G.tilt_peak(d, ["id"], "a", "w")._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not [x for x in exchanges if "_groupingexpression" in x]


def test_lag_pairs_over_chunk_ends(spark):
    from starfold.operators.segments import lag_pairs

    d = spark.createDataFrame([("long", k, k) for k in range(53)] + [("short", k, 100 + k) for k in range(5)], "g string, t long, id long")
    for width in (1, 3, 5):
        p = lag_pairs(d, "g", "t", width, [], "id")
        want = {(a, b) for lo, hi in ((0, 53), (100, 105)) for a in range(lo, hi) for b in range(a + 1, min(hi, a + width + 1))}
        got = [(r["id_i"], r["id_j"]) for r in p.collect()]
        assert len(got) == len(want) and set(got) == want
