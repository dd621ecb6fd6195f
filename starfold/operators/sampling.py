"""Reproducible stratified samples (Q1-Q16).

Draws follow md5 order, never a random generator, so they do not depend on partitioning.  Samplers that are
sequential elsewhere are defined here by hash order and rounds; caps and quotas hold exactly.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import HASH_SPAN, add_position, as_list, checkpoint, hash_bucket, hash_int, hash_position, match, score_position, sorted_position, written

# Fixed values of the sampling policy.
ROLES = ("high", "disagreement", "mid", "low", "random")
RATING_SHARES = {3: 0.53, 4: 0.27, 5: 0.20}


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int | Column, by=None, out: str = "quota") -> DataFrame:
    """Q1: integers proportional to ``weight`` that sum to ``total`` (weights of a group sum to 1); ties by key.

    The remainders are ranked by one sort of all groups, so neither a group nor the whole table meets in one task.
    """
    by = as_list(by)
    total = F.lit(total) if isinstance(total, int) else total
    d = weights.withColumn("__raw", total * F.col(weight)).withColumn("__base", F.floor(F.round("__raw", 9)))
    d = d.withColumn("__rest", F.round(F.col("__raw") - F.col("__base"), 9))
    sums = d.groupBy(*by).agg(F.sum("__base").alias("__sum"))
    d = match(d, sums, by) if by else d.crossJoin(F.broadcast(sums))  # one row
    d = sorted_position(d.withColumn("__left", total - F.col("__sum")), by, [F.col("__rest").desc(), key], "__rank")
    extra = (F.col("__rank") <= F.col("__left")).cast("int")
    return d.withColumn(out, (F.col("__base") + extra).cast("long")).drop("__raw", "__base", "__rest", "__sum", "__left", "__rank")


def quotas(counts: DataFrame, key: str, count: str, total: int, min_per: int) -> DataFrame:
    """Q1: at least ``min_per`` per key (all if fewer), the rest by the share of what is left.  One row per stratum."""
    d = counts.withColumn("__min", F.least(F.lit(min_per), F.col(count)))
    sums = d.agg(F.sum("__min").alias("__used"), F.sum(F.col(count) - F.col("__min")).alias("__excess"))
    d = d.crossJoin(F.broadcast(sums)).withColumn("__share", F.coalesce(F.try_divide(F.col(count) - F.col("__min"), F.col("__excess")), F.lit(0.0)))
    left = F.greatest(F.lit(total) - F.col("__used"), F.lit(0))
    d = largest_remainder(d, key, "__share", left, out="__extra")
    return d.withColumn("quota", F.col("__min") + F.col("__extra")).drop("__min", "__used", "__excess", "__share", "__extra")


def round_robin(df: DataFrame, by, seg, key: str, seed: str, first: str | None = None) -> DataFrame:
    """Q2/Q14: position ``rr`` that visits the segments of a group in turn, larger segments first.

    Inside a segment rows come in hash order (after ``first`` descending, if given).  A prefix of ``rr`` is the draw.
    Rounds are laid out by one sort of (group, round, size, segment): a round with very many segments lies in several tasks.
    """
    by, seg = as_list(by), as_list(seg)
    keys = list(dict.fromkeys([*by, *seg]))
    d = df.withColumn("__h", hash_int(seed, key))
    inner = [F.col(first).desc()] if first else []
    bucket = hash_bucket(F.col("__h")) if first is None else F.when(F.col(first) == 1, 0).otherwise(1) * HASH_SPAN + hash_bucket(F.col("__h"))
    d = add_position(d, keys, [*inner, "__h", key], bucket, "__round")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    d = match(d, sizes, keys)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in seg])
    d = d.withColumn("__name", name)
    return sorted_position(d, by, ["__round", F.col("__size").desc(), "__name"], "rr").drop("__h", "__round", "__size", "__name")


def stratified_sample(items: DataFrame, event: str, seg, key: str, rating: str, total: int, min_per: int, shares=RATING_SHARES, seed: str = "strat") -> DataFrame:
    """Q3: event quota x rating quota with the deficit of one star carried to the next, spread over segments."""
    pool = items.where(F.col(rating).isin(list(shares)))
    counts = pool.groupBy(event).agg(F.count(F.lit(1)).alias("n"))
    q = quotas(counts, event, "n", total, min_per).select(event, "quota")
    table = items.sparkSession.createDataFrame(list(shares.items()), f"{rating} int, share double")
    want = largest_remainder(q.crossJoin(F.broadcast(table)), rating, "share", F.col("quota"), by=event, out="want")  # literal stars
    have = pool.groupBy(event, rating).agg(F.count(F.lit(1)).alias("have"))
    d = want.join(have, [event, rating], "left").fillna(0, ["have"])
    w = W.partitionBy(event)
    run = w.orderBy(rating).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__take", F.least("want", "have")).withColumn("__short", F.col("quota") - F.sum("__take").over(w))
    d = d.withColumn("__room", F.col("have") - F.col("__take"))
    given = F.coalesce(F.sum("__room").over(run), F.lit(0))
    d = d.withColumn("take", F.col("__take") + F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__short") - given)))
    rr = round_robin(pool, [event, rating], seg, key, seed)
    return rr.join(d.select(event, rating, "take"), [event, rating]).where(F.col("rr") <= F.col("take")).drop("rr", "take")


def capped_pairs(candidates: DataFrame, max_uses: int, quota: int, seed: str, done: DataFrame | None = None) -> DataFrame:
    """Pairs accepted in hash order such that no item is used more than ``max_uses`` times and no stratum exceeds ``quota``.

    ``candidates`` has ``stratum, id_i, id_j``; ``done`` are pairs accepted before, which stay.  Each round leaves out the pairs of
    exhausted items, ranks the others and accepts those within the remaining uses of both ends; uses are exact at every
    round.  The first pair in hash order is always accepted, so it goes on until every stratum is full or no candidate is
    left that both ends allow.
    """
    pending = checkpoint(candidates.withColumn("__h", hash_int(seed, "stratum", "id_i", "id_j")))
    if done is None:
        done = pending.drop("__h").limit(0)
    done = checkpoint(done)
    while True:
        used = done.select(F.explode(F.array("id_i", "id_j")).alias("__e")).groupBy("__e").agg(F.count(F.lit(1)).alias("__u"))
        have = done.groupBy("stratum").agg(F.count(F.lit(1)).alias("__n"))
        spent = used.where(F.col("__u") >= max_uses).select("__e")
        open_ = pending.join(done, ["stratum", "id_i", "id_j"], "left_anti").join(have.where(F.col("__n") >= quota), "stratum", "left_anti")
        for end in ("id_i", "id_j"):
            open_ = open_.join(spent.withColumnRenamed("__e", end), end, "left_anti")
        pending = checkpoint(open_.select("stratum", "id_i", "id_j", "__h"))
        if pending.isEmpty():
            return done
        good = _capped_round(pending, used, have, max_uses, quota)
        done = checkpoint(done.select("stratum", "id_i", "id_j").unionByName(good))


def _capped_round(pending: DataFrame, used: DataFrame, have: DataFrame, max_uses: int, quota: int) -> DataFrame:
    """The pairs one round accepts; whether a pair is accepted depends only on pairs that come earlier in hash order."""
    ends = pending.select("stratum", "id_i", "id_j", "__h", F.explode(F.array("id_i", "id_j")).alias("__e"))
    order = W.partitionBy("__e").orderBy("__h", "stratum", "id_i", "id_j")
    ranked = ends.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= max_uses)
    ranked = ranked.join(used, "__e", "left").where(F.col("__r") <= max_uses - F.coalesce("__u", F.lit(0)))
    good = ranked.groupBy("stratum", "id_i", "id_j", "__h").agg(F.count(F.lit(1)).alias("__k")).where("__k = 2").drop("__k")
    good = good.withColumn("__p", F.row_number().over(W.partitionBy("stratum").orderBy("__h", "id_i", "id_j"))).join(have, "stratum", "left")
    return good.where(F.col("__p") <= quota - F.coalesce("__n", F.lit(0))).select("stratum", "id_i", "id_j")


STRATA = ("same_star_cross_event", "cross_star_cross_event", "same_star_cross_segment", "extremes")


def pair_shortage(pairs: DataFrame, quota: int) -> DataFrame:
    """Q4: pairs and missing pairs (``n``, ``short``) of every stratum, those without any pair included."""
    names = pairs.sparkSession.createDataFrame([(n,) for n in STRATA], "stratum string")
    n = pairs.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return names.join(n, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.lit(0), quota - F.coalesce("n", F.lit(0))).alias("short"))


def pair_strata(items: DataFrame, key: str, rating: str, event: str, seg, quota: int, max_uses: int = 2, seed: str = "strata", tries: int = 4, head: int = 4000) -> DataFrame:
    """Q4: labelled-pair candidates: same star across events, other star across events by gap, same star across segments
    of one event, extremes (4-5 against 0-1) across events; an item is used at most ``max_uses`` times, sides are random.

    Candidates come first from matching two hash orders rank by rank (``tries`` shifts per stratum).  While a stratum is short,
    the items that are not exhausted are offered again: of each pool and star the first ones in turns over its events or
    segments, all against all.  They are more than twice ``max_uses``, so if any pair is still allowed, one of them is; it ends
    when every stratum is full or no pair is allowed.  A stratum costs a few rows per item and never a product of its
    groups.  ``pair_shortage`` tells what is missing.

    Pairs are accepted in hash order, so the pairs up to a hash that about ``head * quota`` candidates do not exceed are looked at
    first.  If they fill every stratum in one round, later pairs cannot change the result; if not, all candidates are ranked.
    """
    seg = as_list(seg)
    where = F.struct(*seg)
    base = written(items.select(F.col(key).alias("id"), F.col(rating).alias("r"), F.col(event).alias("e"), where.alias("s")))
    low, high = F.col("r") <= 1, F.col("r") >= 4
    blocks = [
        ("same_star_cross_event", F.concat(F.lit("r"), F.col("r").cast("string")), F.lit(True), "e_i <> e_j and r_i = r_j"),
        ("cross_star_cross_event", F.lit("all"), F.lit(True), "e_i <> e_j and abs(r_i - r_j) between 1 and 3"),
        ("same_star_cross_segment", F.concat_ws("/", F.col("e"), F.col("r").cast("string")), F.lit(True), "e_i = e_j and s_i <> s_j and r_i = r_j"),
        ("extremes", F.lit("all"), low | high, "e_i <> e_j and abs(r_i - r_j) >= 3 and greatest(r_i, r_j) >= 4 and least(r_i, r_j) <= 1"),
    ]
    tagged = base.select("*", F.explode(F.array(*[
        F.struct(F.lit(n).alias("stratum"), F.when(use, pool).alias("pool")) for n, pool, use, _ in blocks])).alias("b")).select("*", "b.*").drop("b").where("pool is not null")
    a = hash_position(tagged, ["stratum", "pool"], f"{seed}-a", "id", "rank")
    b = hash_position(tagged, ["stratum", "pool"], f"{seed}-b", "id", "rank")
    spot = lambda shift: F.floor((F.col("rank") + shift) / tries)
    left = a.withColumn("__at", F.explode(F.sequence(spot(0), spot(tries - 1)))).select("stratum", "pool", "__at", F.col("rank").alias("rank_i"), *[F.col(c).alias(f"{c}_i") for c in ("id", "r", "e", "s")])
    right = b.select("stratum", "pool", spot(0).alias("__at"), F.col("rank").alias("rank_j"), *[F.col(c).alias(f"{c}_j") for c in ("id", "r", "e", "s")])
    rule = F.lit(False)
    for n, _, _, cond in blocks:
        rule = rule | ((F.col("stratum") == n) & F.expr(cond))
    lesser, greater = F.least("id_i", "id_j"), F.greatest("id_i", "id_j")
    def allowed(pairs: DataFrame, last: int | None = None) -> DataFrame:
        pairs = pairs.where((F.col("id_i") != F.col("id_j")) & rule)
        if last is not None:  # a pair stays in all its strata or in none, since the first of them gets it
            pairs = pairs.where(F.least(F.lit(1 << 32), *[F.when(F.expr(cond), hash_int(seed, F.lit(n), lesser, greater)) for n, _, _, cond in blocks]) <= last)
        pairs = pairs.select("stratum", F.least("id_i", "id_j").alias("id_i"), F.greatest("id_i", "id_j").alias("id_j")).distinct()
        first = F.row_number().over(W.partitionBy("id_i", "id_j").orderBy("stratum"))
        return pairs.withColumn("__f", first).where("__f = 1").drop("__f")

    matched, n, picked = left.join(right, ["stratum", "pool", "__at"]).where((F.col("rank_j") - F.col("rank_i")).between(0, tries - 1)), -1, None
    last = (head * quota << 32) // max(1, base.count() * len(blocks) * tries)
    if last < 1 << 32:
        first = checkpoint(allowed(matched, last).withColumn("__h", hash_int(seed, "stratum", "id_i", "id_j")).where(F.col("__h") <= last))
        none = first.limit(0)
        picked = checkpoint(_capped_round(first, none.select(F.col("id_i").alias("__e"), F.lit(0).alias("__u")), none.select("stratum", F.lit(0).alias("__n")), max_uses, quota))
        if picked.count() < quota * len(blocks):
            picked = None
    if picked is None:
        picked = capped_pairs(allowed(matched), max_uses, quota, seed)
    pools = tagged.groupBy("stratum", "pool", "r").agg(F.count(F.lit(1)).alias("n")).groupBy("stratum").agg(F.count(F.lit(1)).alias("pools"))
    pools = checkpoint(pools.select("stratum", F.greatest(F.lit(2 * max_uses + 1), F.ceil(F.lit(2 * quota) / F.col("pools"))).alias("__take")))
    while (before := n) < (n := picked.count()):
        full = picked.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= quota).select("stratum")
        if full.count() == len(blocks):
            break
        used = picked.select(F.explode(F.array("id_i", "id_j")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        free = tagged.join(full, "stratum", "left_anti").join(used.where(F.col("n") >= max_uses), "id", "left_anti").join(pools, "stratum")
        side = F.when(F.col("stratum") == "same_star_cross_segment", F.struct(F.lit(None).cast("string").alias("e"), "s")).otherwise(F.struct(F.col("e").cast("string").alias("e"), F.lit(None).cast(base.schema["s"].dataType).alias("s")))
        turn = hash_position(free.withColumn("__side", side), ["stratum", "pool", "r", "__side"], f"{seed}-turn", "id", "__turn").where(F.col("__turn") <= F.col("__take"))
        turn = add_position(turn.withColumn("__h", hash_int(f"{seed}-turn", "id")), ["stratum", "pool", "r"], ["__turn", "__h", "id"], F.col("__turn"), "rank").where(F.col("rank") <= F.col("__take"))
        turn = checkpoint(turn.select("stratum", "pool", "id", "r", "e", "s"))
        one, two = (turn.select("stratum", "pool", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "r", "e", "s")]) for x in "ij")
        more = allowed(one.join(two, ["stratum", "pool"]).where("id_i < id_j"))
        picked = capped_pairs(more.join(picked, ["id_i", "id_j"], "left_anti"), max_uses, quota, seed, picked)
    flip = hash_int(f"{seed}-side", "id_i", "id_j") % 2 == 1
    return picked.select("stratum", F.when(flip, F.col("id_j")).otherwise(F.col("id_i")).alias("photo_a"), F.when(flip, F.col("id_i")).otherwise(F.col("id_j")).alias("photo_b"))


def representative_pool(items: DataFrame, event: str, seg, cluster, key: str, rating: str, centrality: str, used: DataFrame, big: int, low_total: int, seg_small: int, seg_cap: int, seed: str = "pool") -> DataFrame:
    """Q5: rules in order, the earlier one wins: top of a big cluster, isolated high, isolated low by event share, top of
    an abnormal segment (small or capped low).  Clusters whose tops are already used are skipped by the first rule.
    """
    seg, cluster = as_list(seg), as_list(cluster)
    u = used.select(key).distinct().withColumn("__used", F.lit(1))
    d = items.join(u, key, "left").withColumn("__used", F.coalesce("__used", F.lit(0)))
    best = F.max(F.struct(F.col(centrality), F.col(key)))
    tops = d.where((F.col("cluster_size") >= big) & (F.col("is_top") == 1))
    r1 = tops.groupBy(*cluster).agg(best.alias("b"), F.max("__used").alias("u")).where("u = 0").select(F.col(f"b.{key}").alias(key), F.lit(1).alias("p"), F.lit("big_cluster_top").alias("role"))
    single = d.where((F.col("cluster_size") == 1) & (F.col("__used") == 0))
    r2 = single.where(F.col(rating) >= 3).select(key, F.lit(2).alias("p"), F.lit("isolated_high").alias("role"))
    low = single.where(F.col(rating) <= 2)
    n = low.groupBy(event).agg(F.count(F.lit(1)).alias("n"))
    share = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t"))))  # one row
    take = share.select(event, F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(low_total) * F.col("n") / F.col("t")))).alias("take"))
    r3 = hash_position(low.select(event, key), event, seed, key, "pos").join(take, event).where("pos <= take").select(key, F.lit(3).alias("p"), F.lit("isolated_low").alias("role"))
    segs = d.groupBy(*seg).agg(F.count(F.lit(1)).alias("n"), F.max(rating).alias("cap"))
    odd = segs.where((F.col("n") < seg_small) | (F.col("cap") <= seg_cap))
    r4 = d.where("__used = 0").join(odd, seg).where(F.col(rating) == F.col("cap")).groupBy(*seg).agg(best.alias("b")).select(F.col(f"b.{key}").alias(key), F.lit(4).alias("p"), F.lit("seg_top").alias("role"))
    allr = r1.unionByName(r2).unionByName(r3).unionByName(r4)
    return allr.groupBy(key).agg(F.min(F.struct("p", "role"))["role"].alias("role"))


def coverage_pool(items: DataFrame, event: str, seg, key: str, rating: str, centrality: str, total: int, low: int = 15, high: int = 20, big: int = 16) -> DataFrame:
    """Q6: per event a clamped quota; one best item per segment first (abnormal and big-cluster segments ahead), then fill.

    The order is (round, rule, key): round 0 is the top of each segment, round 1 everything else by rule.
    """
    seg = as_list(seg)
    segs = items.groupBy(*dict.fromkeys([event, *seg])).agg(F.count(F.lit(1)).alias("__n"), F.max(rating).alias("__cap"), F.max(F.struct(rating, centrality, key))[key].alias("__top"))
    n = segs.groupBy(event).agg(F.count(F.lit(1)).alias("segs"))
    quota = n.crossJoin(F.broadcast(n.agg(F.sum("segs").alias("__t"))))  # one row
    quota = quota.select(event, F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.lit(total) * F.col("segs") / F.col("__t")))).cast("long").alias("quota"))
    d = items.join(segs, list(dict.fromkeys([event, *seg])))
    top = F.col(key) == F.col("__top")
    odd = (F.col("__n") < 8) | (F.col("__cap") <= 2)
    bigtop = (F.col("cluster_size") >= big) & (F.col("is_top") == 1)
    hi = (F.col("cluster_size") == 1) & (F.col(rating) >= 3)
    lo = (F.col("cluster_size") == 1) & (F.col(rating) <= 2)
    rule = F.when(top & odd, 0).when(top & bigtop, 1).when(top & hi, 2).when(top, 3).when(bigtop, 4).when(hi, 5).when(lo, 6)
    role = F.when(F.col("__rule").isin(0, 3), "seg_top").when(F.col("__rule").isin(1, 4), "big_cluster_top").when(F.col("__rule").isin(2, 5), "isolated_high").otherwise("isolated_low")
    d = d.withColumn("__rule", rule).where("__rule is not null").withColumn("__h", hash_int("cover", key))
    d = add_position(d, event, ["__rule", "__h", key], F.col("__rule") * HASH_SPAN + hash_bucket(F.col("__h")), "__pos").join(quota, event)
    return d.where(F.col("__pos") <= F.col("quota")).select(event, *[c for c in seg if c != event], key, role.alias("role"), "quota")


def hidden_duplicates(picks: DataFrame, key: str, fraction: float, prefix: str, seed: str = "dup") -> DataFrame:
    """Q7: add a repeated share of the picks, shuffle, give sequential neutral names; copies point to the original's id."""
    n = picks.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction)).alias("__d"))
    order = hash_position(picks.select(key), [], f"{seed}-pick", key, "__p").crossJoin(F.broadcast(n))  # one row
    copies = order.where(F.col("__p") <= F.col("__d")).select(key, F.lit(1).alias("is_dup"))
    both = picks.select(key, F.lit(0).alias("is_dup")).unionByName(copies).withColumn("__k", F.concat_ws("#", F.col(key).cast("string"), F.col("is_dup").cast("string")))
    named = hash_position(both, [], seed, "__k", "__n")
    pointer = F.when(F.col("is_dup") == 1, F.col(key))
    return named.select(F.concat(F.lit(prefix), F.lpad(F.col("__n").cast("string"), 6, "0")).alias("new_name"), key, pointer.alias("is_dup_of"))


def cluster_exam(clusters: DataFrame, event: str, seg, key: str, stratum: str, quota: dict[str, int], per_seg: int, seed: str = "exam") -> DataFrame:
    """Q8: clusters per stratum in hash order, at most ``per_seg`` per segment and a soft cap per event; the second pass
    drops the soft cap.  Events get ``max(4, round(1.5 * total * share))`` in the first pass.
    """
    seg = as_list(seg)
    total = sum(quota.values())
    d = clusters.withColumn("__h", hash_int(seed, key))
    d = d.withColumn("__s", F.row_number().over(W.partitionBy(*dict.fromkeys([event, *seg])).orderBy("__h", key))).where(F.col("__s") <= per_seg)
    n = clusters.groupBy(event).agg(F.count(F.lit(1)).alias("n"))
    soft = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select(event, F.greatest(F.lit(4), F.bround(total * F.col("n") / F.col("t") * 1.5)).alias("__soft"))  # one row
    d = add_position(d, event, ["__h", key], hash_bucket(F.col("__h")), "__e").join(soft, event)
    d = d.withColumn("pass", F.when(F.col("__e") <= F.col("__soft"), 1).otherwise(2))
    caps = F.create_map(*[x for k, v in sorted(quota.items()) for x in (F.lit(k), F.lit(v))])
    d = add_position(d, stratum, ["pass", "__h", key], F.col("pass") * HASH_SPAN + hash_bucket(F.col("__h")), "__q")
    return d.where(F.col("__q") <= F.try_element_at(caps, F.col(stratum))).select(*clusters.columns, "pass")


def cluster_cards(items: DataFrame, cluster, key: str, vec: str, latent: str, fallback: str) -> DataFrame:
    """Q9: per cluster the mean pair cosine and the quantile band value of its middle latent score.

    The mean cosine of m unit vectors is (|sum|^2 - m) / (m (m - 1)), so no pairs are formed.  Clusters of one row have no card:
    their rows count for the quantile only, their vectors are left out before they are normalised and summed.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from starfold.core import dot, tie_blocks
    from starfold.functions.vectors import l2_normalize

    cluster = as_list(cluster)
    d = written(items.select(*cluster, key, F.coalesce(F.col(latent), F.col(fallback).cast("double")).alias("__lat")))
    sizes = written(d.groupBy(*cluster).agg(F.count(F.lit(1)).alias("size")).where("size >= 2"))
    u = items.select(*cluster, vec).join(sizes, cluster, "left_semi").select(*cluster, l2_normalize(F.col(vec)).alias("__u"))
    g = u.groupBy(*cluster).agg(
        F.count(F.lit(1)).alias("size"), vector_to_array(Summarizer.sum(array_to_vector("__u"))).alias("__sum"), F.sum(dot(F.col("__u"), F.col("__u"))).alias("__self"))
    g = g.withColumn("cos", (dot(F.col("__sum"), F.col("__sum")) - F.col("__self")) / (F.col("size") * (F.col("size") - 1))).drop("__sum", "__self")
    r = sorted_position(d.join(sizes, cluster), cluster, ["__lat", key], "__r")
    mid = r.where((F.col("__r") == F.floor(F.col("size") / 2) + 1) & F.col("__lat").isNotNull()).select(*cluster, F.col("__lat").alias("mid"))
    total = d.agg(F.count(F.lit(1)).alias("__n"))
    low = tie_blocks(d.select("__lat"), [], "__lat").crossJoin(F.broadcast(total))  # one row
    q = low.select(F.col("__lat").alias("mid"), ((F.col("n_total") - F.col("n_above") - F.col("n")) / F.col("__n")).alias("lat_q"))
    return g.join(mid, cluster).join(q, "mid", "left")


def band_exam(cards: DataFrame, seg, key: str, split: str, quotas_by_band: dict[str, int], test_quota: int, cos_hi: float, hi_share: float, test_hi: int, per_seg: int, seed: str = "band") -> DataFrame:
    """Q9: test side: very similar clusters first (at most ``test_hi``), then by latent quantile; train side: bands top /
    mid / bot at .67 and .33 with a capped share of very similar clusters; at most ``per_seg`` per segment overall.
    """
    seg = as_list(seg)
    d = cards.withColumn("__h", hash_int(seed, key)).withColumn("__hi", (F.col("cos") >= cos_hi).cast("int"))
    band = F.when(F.col(split) == "test", "exam").when(F.col("lat_q") >= 0.67, "train_top").when(F.col("lat_q") >= 0.33, "train_mid").otherwise("train_bot")
    d = d.where(F.col(split).isin("train", "test")).withColumn("band", band)
    d = d.withColumn("__s", F.row_number().over(W.partitionBy(*seg).orderBy("__h", key))).where(F.col("__s") <= per_seg)
    d = checkpoint(d.drop("__s"))
    caps = {"exam": test_quota, **{f"train_{k}": v for k, v in quotas_by_band.items()}}
    hi_caps = {"exam": test_hi, **{f"train_{k}": int(round(v * hi_share)) for k, v in quotas_by_band.items()}}
    lit_map = lambda m: F.create_map(*[x for k, v in sorted(m.items()) for x in (F.lit(k), F.lit(v))])
    d = add_position(d, ["band", "__hi"], ["__h", key], hash_bucket(F.col("__h")), "__g")
    d = d.where((F.col("__hi") == 0) | (F.col("__g") <= F.try_element_at(lit_map(hi_caps), F.col("band"))))
    rank = F.when(F.col("band") == "exam", F.when(F.col("__hi") == 1, -1.0).otherwise(1 - F.col("lat_q"))).otherwise(F.col("__h") / float(1 << 32))
    d = d.withColumn("__o", rank)
    d = add_position(d, "band", ["__o", "__h", key], F.floor(F.col("__o") * 512), "__q")
    return d.where(F.col("__q") <= F.try_element_at(lit_map(caps), F.col("band"))).select(*cards.columns, "band")


def trim_members(members: DataFrame, gid, key: str, is_top: str, centrality: str, most: int = 6) -> DataFrame:
    """Q10: groups above ``most`` keep their tops and a stride over the rest by centrality."""
    gid = as_list(gid)
    n = members.groupBy(*gid).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(is_top) == 1).alias("__t"))
    order = [F.col(is_top).desc(), F.col(centrality).desc(), key]
    bucket = F.when(F.col(is_top) == 1, 0).otherwise(1_000_000) + F.floor(-F.col(centrality) * 1000)
    d = add_position(members, gid, order, bucket, "__r").join(n, gid)
    rest = F.col("__n") - F.col("__t")
    stride = F.greatest(F.lit(1), F.floor(rest / (most - 1)))
    at = F.col("__r") - F.col("__t") - 1
    keep = (F.col("__n") <= most) | ((F.col(is_top) == 1) & (F.col("__r") <= most)) | (
        (F.col(is_top) != 1) & (at % stride == 0) & (F.floor(at / stride) < most - F.col("__t")))
    return d.where(keep).drop("__r", "__n", "__t")


def anonymise(members: DataFrame, gid: str, key: str, prefix: str = "R", seed: str = "anon") -> DataFrame:
    """Q11: shuffled group numbers and slots A, B, ...; the result is the key table and stays apart from the sheet."""
    groups = hash_position(members.select(gid).distinct(), [], seed, gid, "__g")
    slot = F.row_number().over(W.partitionBy(gid).orderBy(hash_int(f"{seed}-slot", gid, key), key))
    d = members.withColumn("__s", slot).join(groups, gid)
    return d.select(
        F.concat(F.lit(prefix), F.lpad(F.col("__g").cast("string"), 6, "0")).alias("r_gid"),
        F.when(F.col("__s") <= 26, F.chr(F.col("__s") + 64)).otherwise(F.concat(F.lit("Z"), F.col("__s").cast("string"))).alias("r_anon"), gid, key)


def mixed_groups(reps: DataFrame, event: str, key: str, score_a: str, score_b: str, groups: int, size: int = 6, seed: str = "mixed") -> DataFrame:
    """Q12/U4: per event ``groups`` groups of ``size`` cluster representatives by role: high, disagreement, mid, low, random.

    The choice is sequential, but every role takes from the head of one order.  Only the heads are needed: at most
    ``groups * size`` rows per role order (around each anchor for mid), found in parallel; the sequential part then
    sees a bounded set per event.
    """
    need = groups * size + 1
    d = reps.select(event, F.col(key).alias("id"), F.col(score_a).cast("double").alias("a"), F.abs(F.col(score_a) - F.col(score_b)).cast("double").alias("dis"))
    d = d.withColumn("h", hash_int(seed, "id"))
    n = d.groupBy(event).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    pos = checkpoint(score_position(checkpoint(d), event, "a", "id", "pos", descending=False).join(n, event))
    anchors = [(g + 0.5) / groups for g in range(groups)]
    near = F.lit(False)
    for f in anchors:
        near = near | (F.abs(F.col("pos") - 1 - F.bround((F.col("n") - 1) * f)) <= need)
    dis = checkpoint(score_position(pos, event, "dis", "id", "dpos"))
    rnd = add_position(dis, event, ["h", "id"], hash_bucket(F.col("h")), "hpos")
    heads = rnd.where(near | (F.col("pos") <= need) | (F.col("pos") > F.col("n") - need) | (F.col("dpos") <= need) | (F.col("hpos") <= need))
    heads = heads.select(event, "id", "a", "dis", "h", "pos", "n")
    kind = reps.schema[key].dataType.simpleString()
    ekind = reps.schema[event].dataType.simpleString()

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """One seat after the other: its queue's first member that has no seat yet."""
        total = int(pdf["n"].iloc[0])
        rank = lambda by: pdf.assign(__k=by).sort_values(["__k", "id"])["id"].tolist()
        level = {g: pdf.loc[pdf["pos"] == round((total - 1) * f) + 1, "a"].iloc[0] for g, f in enumerate(anchors)}
        queues = {"high": rank(-pdf["a"]), "disagreement": rank(-pdf["dis"]), "low": rank(pdf["a"]), "random": rank(pdf["h"])}
        queues |= {("mid", g): rank((pdf["a"] - x).abs()) for g, x in level.items()}
        seats = [(g, s, ROLES[s] if s < min(len(ROLES), size - 1) else "random") for g in range(min(groups, total // size)) for s in range(size)]
        waiting, seated, out = {k: iter(v) for k, v in queues.items()}, set(), []
        for g, s, role in seats:
            chosen = next(i for i in waiting["mid", g] if i not in seated) if role == "mid" else next(i for i in waiting[role] if i not in seated)
            seated.add(chosen)
            out.append((pdf[event].iloc[0], g + 1, chr(ord("A") + s), chosen, role))
        return pd.DataFrame(out, columns=[event, "grp", "anon", key, "role"])

    return heads.groupBy(event).applyInPandas(deal, f"{event} {ekind}, grp int, anon string, {key} {kind}, role string")


def comparison_tasks(members: DataFrame, event: str, gid: str, key: str, score_a: str, score_b: str, n: int, near: float = 0.08, seed: str = "task") -> DataFrame:
    """Q13: per event ``n`` cross-group pairs: a third of the closest near pairs, a third of the closest disagreements, the
    rest random; sides are random.  Input is the bounded output of the mixed groups.
    """
    from starfold.operators.joins import pairs_in_groups

    members = checkpoint(members)
    p = pairs_in_groups(members, event, key, [gid, score_a, score_b]).where(F.col(f"{gid}_i") != F.col(f"{gid}_j"))
    da, db = F.col(f"{score_a}_i") - F.col(f"{score_a}_j"), F.col(f"{score_b}_i") - F.col(f"{score_b}_j")
    role = F.when(da * db < 0, "disagreement").when(F.abs(da) < near, "near").otherwise("random")
    p = p.select(event, f"{key}_i", f"{key}_j", role.alias("role"), (F.abs(da) + F.abs(db)).alias("gap"), hash_int(seed, f"{key}_i", f"{key}_j").alias("__h"))
    w = W.partitionBy(event, "role").orderBy(F.round("gap", 9), "__h", f"{key}_i", f"{key}_j")
    p = p.withColumn("__head", (F.col("role") != "random") & (F.row_number().over(w) <= n // 3))
    p = p.withColumn("__r", F.row_number().over(W.partitionBy(event).orderBy(F.col("__head").desc(), "__h", f"{key}_i", f"{key}_j"))).where(F.col("__r") <= n)
    flip = hash_int(f"{seed}-side", f"{key}_i", f"{key}_j") % 2 == 1
    return p.select(event, F.when(flip, F.col(f"{key}_j")).otherwise(F.col(f"{key}_i")).alias("photo_a"), F.when(flip, F.col(f"{key}_i")).otherwise(F.col(f"{key}_j")).alias("photo_b"), "role")


def active_draw(items: DataFrame, by, seg, key: str, k: int, mode: str, is_top: str = "is_top", seed: str = "active") -> DataFrame:
    """Q14: ``k`` labelled items per group: ``active`` = round robin over segments, tops first; ``random`` = uniform."""
    if mode == "random":
        return hash_position(items, by, seed, key, "rr").where(F.col("rr") <= k)
    return round_robin(items, by, seg, key, seed, first=is_top).where(F.col("rr") <= k)


def balanced_batches(pairs: DataFrame, domain: str, event: str, group: str, key: str, batches: int, size: int, share: dict[str, int], seed: str = "batch") -> DataFrame:
    """Q15: per batch a fixed number of slots per domain; inside a domain event, group and pair are uniform in turn.

    Slots are rows; each picks its event, group and pair by index, found with equi-joins on (domain, event, group, pair) indexes.
    All pairs are counted per group once; only the pairs of groups that a slot picked are numbered.
    """
    keys = pairs.select(domain, event, group, key)
    groups = written(keys.groupBy(domain, event, group).agg(F.count(F.lit(1)).alias("__pn")))
    gr = hash_position(groups, [domain, event], seed, group, "__gi")
    n_gr = checkpoint(groups.groupBy(domain, event).agg(F.count(F.lit(1)).alias("__gn")))
    ev = hash_position(n_gr, domain, seed, event, "__ei")
    n_ev = n_gr.groupBy(domain).agg(F.count(F.lit(1)).alias("__en"))
    edges, at = F.when(F.lit(False), F.lit("")), 0
    for name, k in share.items():
        at += k
        edges = edges.when(F.col("slot") < at, F.lit(name))
    s = pairs.sparkSession.range(batches * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("slot"), F.col("id").alias("__id"))
    s = s.withColumn(domain, edges).join(n_ev, domain).withColumn("__ei", hash_int(f"{seed}-e", "__id") % F.col("__en") + 1).join(ev, [domain, "__ei"])
    s = s.withColumn("__gi", hash_int(f"{seed}-g", "__id") % F.col("__gn") + 1).join(gr, [domain, event, "__gi"])
    s = written(s.withColumn("__pi", hash_int(f"{seed}-p", "__id") % F.col("__pn") + 1))
    picked = checkpoint(keys.join(s.select(domain, group), [domain, group], "left_semi"))  # by two keys, so that the filter can move below the distinct pairs
    pr = hash_position(picked, [domain, event, group], seed, key, "__pi")
    s = s.join(pr, [domain, event, group, "__pi"])
    return s.select("batch", "slot", domain, event, group, key)


def event_subsets(items: DataFrame, event: str, sizes: list[int], draws: int, seed: str = "subset") -> DataFrame:
    """Q16: learning-curve folds: for each held-out event, size and draw that many training events.

    Every draw is one hash order of the events; a held-out event takes the first ``size`` others of that order, found by
    an equi-join on (draw, position), so nothing is multiplied out.
    """
    e = items.select(event).distinct().withColumn("draw", F.explode(F.array(*[F.lit(i) for i in range(draws)])))
    e = e.withColumn("__h", hash_int(seed, "draw", event))
    ordered = checkpoint(add_position(e, "draw", ["__h", event], hash_bucket(F.col("__h")), "__pos").drop("__h"))
    held = ordered.select(F.col(event).alias("held_out"), "draw", F.col("__pos").alias("__own"))
    held = held.withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
    held = held.withColumn("__pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size").cast("long") + 1)))
    last = F.col("size") + (F.col("__own") <= F.col("size")).cast("int")
    held = held.where((F.col("__pos") != F.col("__own")) & (F.col("__pos") <= last))
    return held.join(ordered, ["draw", "__pos"]).select("held_out", "size", "draw", event)
