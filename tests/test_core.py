"""Ordering helpers against plain windows and numpy, with one hot group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold import core
from starfold.operators import segments as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", rng.choice([0.5, -1.25, 1e-4, 7.0, float(rng.randint(-50, 50)), rng.random() * 1e4]), rng.randrange(0, 10**12)) for i in range(3000)]
    return spark.createDataFrame(data, "id long, g string, s double, t long").cache()


def test_position_equals_plain_window(rows):
    for desc in (True, False):
        got = core.score_position(rows, "g", "s", "id", "pos", desc, tie_block=5)
        order = F.col("s").desc() if desc else F.col("s").asc()
        want = rows.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy(order, core.hash_int("tie", "id"), "id")))
        assert got.join(want.select("id", "w"), "id").where("pos <> w").count() == 0
    got = core.hash_position(rows, "g", "x", "id", "pos").withColumn("h", core.hash_int("x", "id"))
    want = got.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("h", "id")))
    assert want.where("pos <> w").count() == 0


def test_tie_blocks_count_everything(rows):
    b = core.tie_blocks(rows, "g", "s", {"even": F.when(F.col("id") % 2 == 0, 1).otherwise(0)})
    for r in b.collect()[:200]:
        d = rows.where((F.col("g") == r["g"]) & (F.col("s") > r["s"]))
        if r["n"] > 1:
            assert d.count() == r["n_above"] and d.where("id % 2 = 0").count() == r["even_above"]
    assert b.agg(F.sum("n")).first()[0] == 3000


def test_quantiles_equal_numpy(rows):
    got = {r["g"]: r for r in core.quantiles(rows, "g", "s", {"a": 0.1, "b": 0.5, "c": 0.999}).collect()}
    for g, r in got.items():
        v = np.array([x["s"] for x in rows.where(F.col("g") == g).select("s").collect()])
        assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(v, [0.1, 0.5, 0.999]))


@pytest.mark.parametrize("by", [["g"], []])
def test_segments_equal_plain_window(rows, by):
    gap = 2 * 10**9
    got = T.segment_by_gap(rows, "t", {"seg": gap}, by)
    w = W.partitionBy(*by).orderBy("t", "id")
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0))
    want = rows.withColumn("cut", cut).withColumn("w", F.sum("cut").over(w)).select("id", "w")
    assert got.join(want, "id").where("seg <> w").count() == 0


def test_gap_of_exactly_the_limit_does_not_cut(spark):
    d = spark.createDataFrame([(1, 0), (2, 10), (3, 21)], "id long, t long")
    assert [r["seg"] for r in T.segment_by_gap(d, "t", {"seg": 10}).orderBy("id").collect()] == [0, 0, 1]


def test_lag_pairs_equal_all_near_positions(rows):
    got = {(r["id_i"], r["id_j"]) for r in T.lag_pairs(rows, "g", "t", 3, []).collect()}
    want = set()
    groups = {}
    for r in sorted(rows.collect(), key=lambda r: (r["t"], r["id"])):
        groups.setdefault(r["g"], []).append(r["id"])
    for ids in groups.values():
        want |= {(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, min(a + 4, len(ids)))}
    assert got == want


def test_first_non_null(spark):
    d = spark.createDataFrame([(1, 2, None, 5), (1, 1, "a", None), (1, 0, None, None)], "k int, o int, a string, b int")
    assert tuple(T.first_non_null(d, "k", ["o"], ["a", "b"]).first()) == (1, "a", 5)


def test_no_plain_group_window_in_ranking_plans(spark, rows):
    plan = core.tie_blocks(rows, "g", "s")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_missing_groups_times_and_scores_are_kept(spark):
    rows = [(1, "a", 10, 0.5), (2, None, 20, 0.2), (3, "a", None, 0.5), (4, "a", 40, None), (5, None, 5, float("nan")), (6, "b", 7, 0.1)]
    df = spark.createDataFrame(rows, "id long, g string, t long, s double")
    get = lambda d, c: {r["id"]: r[c] for r in d.collect()}
    assert get(core.sorted_position(df, "g", ["t", "id"], "p"), "p") == {1: 2, 2: 2, 3: 1, 4: 3, 5: 1, 6: 1}
    assert get(core.score_position(df, "g", "s", "id", "p"), "p").keys() == {1, 2, 3, 4, 5, 6}
    assert {k: v for k, v in get(core.score_position(df, "g", "s", "id", "p"), "p").items() if v is None} == {4: None, 5: None}
    assert get(core.rank_in_group(df, "g", "s", "r"), "r") == {1: 1.5, 2: 1.0, 3: 1.5, 4: None, 5: None, 6: 1.0}
    assert get(core.hash_position(df, "g", "x", "id", "p"), "p").keys() == {1, 2, 3, 4, 5, 6}
    assert get(T.segment_by_gap(df, "t", {"seg": 15}, ["g"]), "seg") == {1: 0, 2: 0, 3: None, 4: 1, 5: 0, 6: 0}
    assert len(get(T.standardise(df, "g", "t"), "z")) == 6
    assert T.lag_pairs(df, ["g"], "t", 2, []).count() == 4


def test_narrow_scores_are_split(spark):
    df = spark.range(100_000).select(F.col("id"), (F.col("id") * 1e-9 + 0.9).alias("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in core.ranged(df, ["s"]).groupBy("__p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(counts) < 40_000


def test_plans_do_not_grow_with_the_shuffle_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("s"))
    before, sizes = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 8000):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sizes.append(len(core.tie_blocks(df, "g", "s")._jdf.queryExecution().optimizedPlan().toString()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert abs(sizes[0] - sizes[1]) < 100


def test_sorted_positions_over_partitions(spark):
    rows = [(i, i % 3 if i % 11 else None, None if i % 13 == 0 else (i * 37) % 50) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["p"] for r in core.sorted_position(df.repartition(5), "g", [F.col("v").desc(), "id"], "p").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in (0, 1, 2, None):
        order = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))


def test_components_of_long_chains(spark):
    from starfold.operators.clusters import connected_components

    n = 600
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 299], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(edges, spark.range(n + 1)).collect()}
    assert got == {i: 0 if i < 300 else 300 if i < n else n for i in range(n + 1)}


def test_written_tables_are_packed(spark):
    df = spark.range(3_000).select(F.concat_ws(" ", *[F.md5(F.concat(F.lit(f"{k}"), (F.col("id") % 700).cast("string"))) for k in range(9)]).alias("text"))
    table = core.written(df)
    files = [p for p in table.inputFiles() if p.endswith(".parquet")]
    assert files and all(".zstd." in p for p in files) and sorted(table.collect()) == sorted(df.collect())
