"""Sampler invariants, solver gradients, sources, gates and incremental ingest."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import fit as X
from starfold.operators import gates as V
from starfold.operators import sampling as Q
from starfold.sources import tables as I
from starfold.streaming import ingest as S


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, f"e{i % 4}", i // 40, i * 7 % 6) for i in range(1200)], "id long, event string, seg long, star int").cache()


def test_quotas_sum_to_total(spark):
    c = spark.createDataFrame([("a", 100), ("b", 37), ("c", 2)], "k string, n long")
    q = {r["k"]: r["quota"] for r in Q.quotas(c, "k", "n", 50, 8).collect()}
    assert sum(q.values()) == 50 and q["c"] == 2 and q["b"] >= 8


def test_pair_strata_respects_caps(items):
    p = Q.pair_strata(items, "id", "star", "event", ["event", "seg"], 40).cache()
    uses = p.select(F.explode(F.array("photo_a", "photo_b")).alias("x")).groupBy("x").count().agg(F.max("count")).first()[0]
    assert uses <= 2 and p.groupBy("stratum").count().agg(F.min("count"), F.max("count")).first() == (40, 40)
    pairs = [tuple(sorted((r["photo_a"], r["photo_b"]))) for r in p.collect()]
    assert len(pairs) == len(set(pairs))


def test_round_robin_visits_every_segment_first(items):
    r = Q.round_robin(items, "event", ["event", "seg"], "id", "s")
    segs = items.groupBy("event").agg(F.count_distinct("seg").alias("k"))
    first = r.join(segs, "event").where("rr <= k").groupBy("event").agg(F.count_distinct("seg").alias("d"), F.first("k").alias("k"))
    assert first.where("d <> k").count() == 0


def test_mixed_groups_are_disjoint_and_full(spark):
    reps = spark.createDataFrame([(i, "e", float(i), float(i * 37 % 101)) for i in range(100)], "id long, event string, a double, b double")
    rows = Q.mixed_groups(reps, "event", "id", "a", "b", 3).collect()
    assert len(rows) == 18 and len({r["id"] for r in rows}) == 18
    assert {r["id"] for r in rows if r["grp"] == 1 and r["role"] == "high"} == {99}


def test_fold_balanced_equals_greedy(spark):
    d = spark.createDataFrame([(u,) for u, n in enumerate([9, 7, 7, 5, 4, 4, 4, 2, 1, 1, 1]) for _ in range(n)], "u long")
    rows = X.fold_balanced(d, "u", 3, "s").collect()
    loads, want = [0, 0, 0], []
    for r in sorted(rows, key=lambda r: -r["items"]):
        f = loads.index(min(loads))
        loads[f] += r["items"]
        want.append((r["items"], f))
    assert sorted((r["items"], r["fold"]) for r in rows) == sorted(want)


def test_pairwise_gradient_and_planted_signal(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    d = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)], "id long, x array<double>")
    s = x @ np.array([2.0, -1.0, 0.0])
    pairs = [(i, j) if s[i] > s[j] else (j, i) for i, j in zip(range(0, 119), range(1, 120))]
    p = spark.createDataFrame(pairs, "winner long, loser long")
    w = np.array(X.fit_pairwise(p, d, "id", "x", 0.01))
    diff = np.array([x[a] - x[b] for a, b in pairs])
    grad = -(diff * (1 / (1 + np.exp(diff @ w)))[:, None]).mean(axis=0) + 0.01 * w
    assert np.abs(grad).max() < 1e-5 and w[0] > 1 and w[1] < -0.3


def test_offsets_are_monotone_and_settle(spark):
    items = spark.createDataFrame([(i, i % 6, f"s{i % 3}", "e") for i in range(90)], "id long, star int, seg string, event string")
    turned = lambda i, j: (i * 7 + j) % 4 == 0  # noqa: E731  a quarter of the constraints is the other way round
    pairs = [(i, j) for i in range(90) for j in range(90) if (i % 6) > (j % 6) and (i * 31 + j) % 11 == 0]
    cons = spark.createDataFrame([(j, i, 1.0) if turned(i, j) else (i, j, 1.0) for i, j in pairs], "winner long, loser long, weight double")
    b, g, norm = X.fit_offsets(cons, items, "id", "star", "seg", "event", tol=1e-2)
    assert all(y >= x for x, y in zip(g, g[1:])) and g[-1] > 1 and b.count() == 3 and norm <= 1e-2
    with pytest.raises(RuntimeError, match="did not settle"):
        X.fit_offsets(cons, items, "id", "star", "seg", "event", max_rounds=2)
    assert abs(b.agg(F.sum(F.col("n") * F.col("b"))).first()[0]) < 1e-6


def test_gates(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, 0.5), (2, 0.5)], "id long, s double")
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {tuple(r) for r in V.assert_scores(d, items, "id", "s").collect()} == {(1, "not_finite"), (2, "duplicate"), (3, "missing")}
    split = spark.createDataFrame([("", "train"), ("b", "val")], "event string, split string")
    ev = spark.createDataFrame([(1, ""), (2, "b")], "id long, event string")
    assert V.assert_split(ev, split, "event").count() == 0  # the empty event name is a real event
    with pytest.raises(V.GateError):
        V.require_empty(V.assert_unique(d, "id"), "ids")


def test_sources(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text('{\n// note\n"excludeKeywords": ["x"], "folders": [{"path": "/a", "recursive": true, "eventLabel": "E"}, {"path": "/b"}]}', encoding="utf-8")
    rows = I.read_manifest(spark, str(m)).orderBy("folder_ix").collect()
    assert [(r["path"], r["recursive"], r["event"]) for r in rows] == [("/a", True, "E"), ("/b", False, "")]
    csv = tmp_path / "t.csv"
    csv.write_bytes("﻿k,v\n# comment\n1,a\n2,\n".encode())
    assert [tuple(r) for r in I.read_delimited(spark, str(csv), schema="k int, v string").collect()] == [(1, "a"), (2, None)]
    (tmp_path / "f").mkdir()
    for n in ("a.JPG", "._b.jpg", "c.txt", "d.arw"):
        (tmp_path / "f" / n).write_bytes(b"x")
    assert {r["name"] for r in I.list_files(spark, [str(tmp_path / "f")]).collect()} == {"a.JPG", "d.arw"}
    out = str(tmp_path / "once")
    d = spark.range(5)
    assert I.write_once(d, out) == "written" and I.write_once(d.repartition(3), out) == "unchanged"
    with pytest.raises(V.GateError):
        I.write_once(spark.range(6), out)
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, x string, y int")
    s = spark.createDataFrame([(1, "c", None), (3, "d", 7)], "id int, x string, y int")
    assert {tuple(r) for r in I.upsert(t, s, "id", ["x"], ["y"]).collect()} == {(1, "c", 5), (2, "b", 6), (3, "d", 7)}


def test_stream_takes_only_quiet_files_once(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.range(3).coalesce(1).write.parquet(src)
    old = [os.path.join(src, f) for f in os.listdir(src) if f.endswith(".parquet")]
    for f in old:
        os.utime(f, (time.time() - 100, time.time() - 100))
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(src)
    run = lambda quiet: S.stream_new_files(spark, src, "id long", out, ck, quiet_seconds=quiet)
    got = lambda: sorted(r["id"] for r in S.read_done(spark, out).collect())
    run(30.0)
    assert got() == [0, 1, 2]  # the new file is still too fresh
    run(0.0)
    assert got() == [0, 1, 2, 10, 11]
    run(0.0)
    assert got() == [0, 1, 2, 10, 11]


def test_resume_guard_refuses_changed_inputs(spark, tmp_path):
    path = str(tmp_path / "id")
    S.resume_guard(spark, path, {"a": spark.range(4)})
    S.resume_guard(spark, path, {"a": spark.range(4)})
    with pytest.raises(V.GateError):
        S.resume_guard(spark, path, {"a": spark.range(5)})


def test_capped_pairs_leave_no_allowed_candidate(spark):
    rows = [("s", i, j) for i in range(24) for j in range(i + 1, 24) if (i * 7 + j * 5) % 6 == 0]
    for seed in ("a", "b", "c"):
        got = [tuple(r) for r in Q.capped_pairs(spark.createDataFrame(rows, "stratum string, id_i long, id_j long"), 1, 99, seed).select("stratum", "id_i", "id_j").collect()]
        taken = [x for _, i, j in got for x in (i, j)]
        assert len(taken) == len(set(taken)) and all({i, j} & set(taken) for _, i, j in rows)


def test_pair_strata_find_scarce_candidates(spark):
    stars = [(i, "main", "s0", 3) for i in range(300)] + [(300 + i, f"e{i % 3}", "s1", 3) for i in range(4)] + [(400, "main", "s1", 3), (401, "e0", "s0", 0), (402, "e1", "s0", 5)]
    items = spark.createDataFrame(stars, "id long, event string, seg string, star int")
    quota, uses = 20, 2
    pairs = Q.pair_strata(items, "id", "star", "event", ["seg"], quota, uses).cache()
    by = {r[0]: r for r in stars}
    got = [(r["stratum"], *sorted((r["photo_a"], r["photo_b"]))) for r in pairs.collect()]
    used, count = {}, {n: 0 for n in Q.STRATA}
    for n, i, j in got:
        count[n] += 1
        used[i], used[j] = used.get(i, 0) + 1, used.get(j, 0) + 1
    assert max(used.values()) <= uses and len({(i, j) for _, i, j in got}) == len(got) and max(count.values()) <= quota
    free = [r for r in stars if used.get(r[0], 0) < uses]
    pair_set = {(i, j) for _, i, j in got}
    for i, e, s, r in free:
        for j, f, t, q in free:
            if i < j and (i, j) not in pair_set:
                gap, other = abs(r - q), e != f
                fits = {"same_star_cross_event": other and gap == 0, "cross_star_cross_event": other and 1 <= gap <= 3, "same_star_cross_segment": not other and s != t and gap == 0,
                        "extremes": other and gap >= 3 and max(r, q) >= 4 and min(r, q) <= 1}
                assert not any(ok and count[n] < quota for n, ok in fits.items()), (i, j)
    assert {r["stratum"]: (r["n"], r["short"]) for r in Q.pair_shortage(pairs, quota).collect()} == {n: (c, quota - c) for n, c in count.items()}
    assert all(by[i] and by[j] for _, i, j in got)


def test_files_of_a_table_kept_as_a_folder_go_by_its_name(spark, tmp_path):
    for name, n in (("a", 10), ("b", 7)):
        spark.range(n).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    files = I.list_files(spark, [str(tmp_path)], extensions=["parquet"])
    assert files.count() == 6 and {r[0] for r in files.select(I.dataset_name("path", "parquet")).collect()} == {"a.parquet", "b.parquet"}
    rows = spark.read.parquet(str(tmp_path / "a.parquet")).select(I.dataset_name(F.col("_metadata.file_path"), "parquet").alias("name"))
    assert {(r["name"], r["count"]) for r in rows.groupBy("name").count().collect()} == {("a.parquet", 10)}


def test_constraints_inside_segments_are_not_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, levels, shrink = 120, 5, 0.02
    star, seg = rng.integers(0, 6, n), rng.integers(0, 8, n)
    items = spark.createDataFrame([(i, int(star[i]), f"s{seg[i]}", "e") for i in range(n)], "id long, star int, seg string, event string")
    ends = [(int(a), int(b)) for a, b in rng.integers(0, n, (400, 2)) if a != b]
    ends = [(a, b) if star[a] + 2 * rng.random() > star[b] else (b, a) for a, b in ends]
    pairs = spark.createDataFrame([(a, b, 1.0 + a % 2) for a, b in ends], "winner long, loser long, weight double")
    made, whole = [], X.checkpoint
    monkeypatch.setattr(X, "checkpoint", lambda df: made.append(whole(df)) or made[-1])
    b, g, norm = X.fit_offsets(pairs, items, "id", "star", "seg", "event", shrink)
    joined = [d for d in made if "s_winner" in d.columns]
    assert joined[-1].where("s_winner = s_loser").count() == 0 < joined[0].where("s_winner = s_loser").count()
    off = {r["seg"]: r["b"] for r in b.collect()}
    at = np.array([off[f"s{k}"] for k in seg])
    size = np.bincount(seg, minlength=8)
    offs = np.array([off[f"s{k}"] for k in range(8)])
    slope, up = 2 * shrink * size * (offs - (size * offs).sum() / n), np.zeros(levels)
    for a, z in ends:
        w = 1.0 + a % 2
        p = -w / (1 + math.exp(g[star[a]] + at[a] - g[star[z]] - at[z]))
        slope[seg[a]] += p
        slope[seg[z]] -= p
        up += [p * (int(star[a] >= k) - int(star[z] >= k)) for k in range(1, levels + 1)]
    u = np.diff(g)
    up[(u <= 0) & (up > 0)] = 0
    total = sum(1.0 + a % 2 for a, _ in ends)
    assert norm <= 5e-3 and math.isclose(math.sqrt((slope ** 2).sum() + (up ** 2).sum()) / total, norm, rel_tol=1e-6)


def counted(spark, rows, schema):
    """A frame of the rows and an accumulator of how many of them were computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(count), schema), seen


def test_balanced_batches_compute_the_pairs_twice_at_most(spark):
    rows = [("golden" if g % 2 else "window", f"e{g % 3}", f"g{g}", f"p{p}") for g in range(40) for p in range(g % 5 + 1)]
    pairs, seen = counted(spark, rows, "source string, event string, grp string, pk string")
    got = Q.balanced_batches(pairs, "source", "event", "grp", "pk", 20, 8, {"golden": 3, "window": 5}).collect()
    assert len({(r["batch"], r["slot"]) for r in got}) == len(got) == 160 and {tuple(r)[2:] for r in got} <= set(rows)
    assert all((r["source"] == "golden") == (r["slot"] < 3) for r in got)
    assert seen.value <= 2 * len(rows)


def test_cluster_cards_and_band_exam_compute_their_input_a_few_times(spark):
    rows = [(i, f"c{i // 3 if i < 30 else i}", [float(i % 5 + 1), float(i * 3 % 7)], None if i % 8 == 0 else i * 7 % 11 / 10, i % 3) for i in range(50)]
    items, seen = counted(spark, rows, "id long, cl string, v array<double>, lat double, star int")
    cards = Q.cluster_cards(items, ["cl"], "id", "v", "lat", "star")
    got = {r["cl"]: r for r in cards.collect()}
    assert seen.value <= 2 * len(rows) and len(got) == 10
    lat = {i: float(star) if x is None else x for i, _, _, x, star in rows}
    for c, r in got.items():
        own = sorted((lat[i], i, v) for i, cl, v, _, _ in rows if cl == c)
        unit = [np.array(v) / np.linalg.norm(v) for _, _, v in own]
        assert r["size"] == 3 and r["mid"] == own[1][0] and r["lat_q"] == sum(x < own[1][0] for x in lat.values()) / len(rows)
        assert abs(r["cos"] - np.mean([unit[0] @ unit[1], unit[0] @ unit[2], unit[1] @ unit[2]])) < 1e-12
    made, seen = counted(spark, [(f"s{i // 2}", f"c{i}", i % 10 / 10, i % 7 / 7, "test" if i % 3 else "train") for i in range(60)], "seg string, cl string, cos double, lat_q double, split string")
    exam = Q.band_exam(made, "seg", "cl", "split", {"top": 3, "mid": 3, "bot": 3}, 8, 0.5, 0.4, 4, 1).collect()
    assert seen.value == 60 and len({r["seg"] for r in exam}) == len(exam) and sum(r["band"] == "exam" for r in exam) == 8


def test_pair_strata_rank_the_head_of_the_candidates_with_the_same_pairs(spark, monkeypatch):
    items = spark.range(6000).selectExpr("id", "concat('e', id % 4) AS event", "id div 40 AS seg", "cast(id * 7 % 6 as int) AS star")
    pairs = lambda **k: sorted(tuple(r) for r in Q.pair_strata(items, "id", "star", "event", ["event", "seg"], 4, **k).collect())
    every, calls, ranked = pairs(head=1 << 40), [], Q.capped_pairs
    monkeypatch.setattr(Q, "capped_pairs", lambda *a: calls.append(1) or ranked(*a))
    assert pairs() == every and len(every) == 16 and not calls
    assert pairs(head=1) == every and calls == [1]  # too short a head: all candidates are ranked
