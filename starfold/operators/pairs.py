"""Preference-pair generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import as_list, checkpoint, dot, hash_int, hash_position, match, once, quantiles, score_position
from starfold.functions.scalars import SIMILARITY_KNOTS, gap_factor, piecewise_weight
from starfold.functions.vectors import scalar_distance, scale_frame
from starfold.operators.joins import attach_endpoints, cross_class_pairs, difference_partners, similar_in_group
from starfold.operators.segments import lag_pairs

# Fixed values of the pair policy.
TIE_COS = 0.98
GLOBAL_WEIGHT = 0.5
DERIVED_WEIGHT = 0.2
DERIVED_PARTNERS = 8


def _is_tie(tau: float, tie_cos: float) -> Column:
    """Near-duplicate with a small technical distance; an unknown distance is not a tie."""
    return (F.col("cos") >= tie_cos) & F.coalesce(F.col("cv_dist") < tau, F.lit(False))


def window_pairs(items: DataFrame, seg, order: str, key: str, rating: str, vec: str, scalars: list[str], max_offset: int,
                 tau: float, knots=SIMILARITY_KNOTS, tie_cos: float = TIE_COS) -> DataFrame:
    """G1: pairs near in time inside a segment with different stars, weighted by similarity and star gap."""
    norm = F.sqrt(dot(F.col(vec), F.col(vec)))
    sized = items.withColumn("__norm", F.when(norm > 0, norm).otherwise(1.0))  # vectors travel as they are: unit vectors are twice as wide
    near = lag_pairs(sized, seg, order, max_offset, [rating, vec, "__norm", *scalars], key).where(F.col(f"{rating}_i") != F.col(f"{rating}_j"))
    near = once(near, "cos", dot(F.col(f"{vec}_i"), F.col(f"{vec}_j")) / (F.col("__norm_i") * F.col("__norm_j"))).drop(f"{vec}_i", f"{vec}_j")
    near = scalar_distance(near, scale_frame(items, scalars), scalars)
    d = F.abs(F.col(f"{rating}_i") - F.col(f"{rating}_j"))
    out = near.select(
        *as_list(seg), f"{key}_i", f"{key}_j", F.lit("window").alias("ptype"),
        (piecewise_weight(F.col("cos"), knots) * gap_factor(d)).alias("weight"), "cos", "cv_dist", d.alias("dstar"))
    return out.where((F.col("weight") > 0) & ~_is_tie(tau, tie_cos))


def event_pairs(items: DataFrame, event, key: str, rating: str, vec: str, scalars: list[str], tau: float,
                tie_cos: float = TIE_COS, weight: float = GLOBAL_WEIGHT) -> DataFrame:
    """Cluster tops with >= 3 stars, every pair of one event with different stars, near-duplicate ties dropped.

    Pairs come from the class join J7; ties come from the similarity join J8, so vectors travel only there.
    """
    tops = items.where((F.col("is_top") == 1) & (F.col(rating) >= 3))
    pairs = cross_class_pairs(tops, event, key, rating, scalars)
    pairs = scalar_distance(pairs, scale_frame(items, scalars), scalars)
    close = similar_in_group(tops, event, key, vec, tie_cos)
    lo, hi = F.least(f"{key}_i", f"{key}_j"), F.greatest(f"{key}_i", f"{key}_j")
    close = close.select(F.col(f"{key}_i").alias("__lo"), F.col(f"{key}_j").alias("__hi"), "cos")
    d = F.col(f"{rating}_i") - F.col(f"{rating}_j")
    j = pairs.withColumn("__lo", lo).withColumn("__hi", hi).join(close, ["__lo", "__hi"], "left")
    j = j.where(~F.coalesce(_is_tie(tau, tie_cos), F.lit(False)))
    return j.select(*as_list(event), f"{key}_i", f"{key}_j", F.lit("global").alias("ptype"),
                    (F.lit(weight) * gap_factor(d)).alias("weight"), "cv_dist", d.alias("dstar"))


def gap_threshold(anchors: DataFrame, batch, key: str, label: str, score: str, default: float = 1.0) -> DataFrame:
    """Median |score difference| over anchor pairs of one batch whose labels are >= 2 apart."""
    pairs = cross_class_pairs(anchors, batch, key, label, [score], min_gap=2)
    gaps = pairs.select(F.abs(F.col(f"{score}_i") - F.col(f"{score}_j")).alias("gap"))
    found = gaps.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(quantiles(gaps, [], "gap", {"threshold": 0.5}))  # one-row frames
    return found.select(F.coalesce("threshold", F.lit(default)).alias("threshold"), "pairs")


def derived_pairs(items: DataFrame, split: str, key: str, score: str, cluster, threshold: float, k: int = DERIVED_PARTNERS,
                  seed: str = "derived", allowed: list[str] | None = None) -> DataFrame:
    """For every cluster top up to ``k`` partners of its split whose score is more than ``threshold`` away.

    The candidates of a top are a prefix and a suffix of the score order.  The candidate count is cut into ``k`` equal
    strata and a hash picks one rank in each, so partners are found by an equi-join on (split, rank): k rows per top,
    never the quadratic candidate set.  A pair is kept once; partners of the same cluster are dropped.
    """
    cl = as_list(cluster)
    tops = items.where((F.col("is_top") == 1) & F.col(score).isNotNull() & ~F.isnan(score))
    if allowed is not None:
        tops = tops.where(F.col(split).isin(allowed))
    tops = checkpoint(tops.select(split, key, score, *cl))
    counts = difference_partners(tops, split, key, score, threshold)
    ranked = score_position(tops, split, score, key, "__rank", descending=False)
    total = tops.groupBy(split).agg(F.count(F.lit(1)).alias("__n"))
    a = tops.join(counts, [split, key]).join(total, split).withColumn("__c", F.col("n_lower") + F.col("n_higher"))
    a = a.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("__m") < F.col("__c"))
    slots = F.least(F.lit(k).cast("long"), F.col("__c"))
    lo = F.floor(F.col("__m") * F.col("__c") / slots)
    width = F.floor((F.col("__m") + 1) * F.col("__c") / slots) - lo
    pick = lo + hash_int(seed, key, "__m") % width
    rank = F.when(pick < F.col("n_lower"), pick + 1).otherwise(F.col("__n") - F.col("n_higher") + pick - F.col("n_lower") + 1)
    a = a.withColumn("__rank", rank.cast("long"))
    b = ranked.select(split, "__rank", F.col(key).alias("__pk"), F.col(score).alias("__ps"), *[F.col(c).alias(f"__p_{c}") for c in cl])
    same = F.lit(True)
    for c in cl:
        same = same & F.equal_null(F.col(c), F.col(f"__p_{c}"))
    j = a.join(b, [split, "__rank"]).where(~same)
    return j.select(
        split, F.least(key, "__pk").alias(f"{key}_i"), F.greatest(key, "__pk").alias(f"{key}_j"), F.lit("derived").alias("ptype"),
        F.lit(DERIVED_WEIGHT).alias("weight"), F.abs(F.col(score) - F.col("__ps")).alias("s_gap")).dropDuplicates([split, f"{key}_i", f"{key}_j"])


def cross_sample(items: DataFrame, key: str, seg, n: int, seed: str = "cross") -> DataFrame:
    """``n`` random pairs of rows from different segments: two hash orders of the table matched rank by rank."""
    seg = as_list(seg)
    a = items.select(F.col(key).alias(f"{key}_i"), F.struct(*seg).alias("__si"))
    b = items.select(F.col(key).alias(f"{key}_j"), F.struct(*seg).alias("__sj"))
    left = hash_position(a, [], f"{seed}-a", f"{key}_i", "__r")
    right = hash_position(b, [], f"{seed}-b", f"{key}_j", "__r")
    pairs = left.join(right, "__r").where((F.col("__si") != F.col("__sj")) & (F.col(f"{key}_i") != F.col(f"{key}_j")))
    return pairs.orderBy("__r").limit(n).select(f"{key}_i", f"{key}_j")


def equivalence_pairs(items: DataFrame, cluster, key: str, rating: str, cap: int = 6, total: int | None = None, seed: str = "tie") -> DataFrame:
    """Pairs of one cluster with the same stars, at most ``cap`` per cluster (and ``total`` overall, in hash order).

    All pairs of a cluster are numbered: by star, then by the hash ranks of their members.  ``cap`` numbers at equal steps from
    a hashed start are drawn and turned back into member ranks, so every pair can be drawn and none is formed in vain.
    """
    cluster = as_list(cluster)
    ranked = hash_position(items.select(*cluster, rating, key), [*cluster, rating], seed, key, "__r")
    n = F.col("__n")
    stars = items.groupBy(*cluster, rating).agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", F.expr("__n * (__n - 1) div 2"))
    w = W.partitionBy(*cluster)  # one row per star
    stars = stars.withColumns({"__all": F.sum("__p").over(w), "__end": F.sum("__p").over(w.orderBy(rating))})
    take, start = F.least(F.lit(cap), F.col("__all")), hash_int(seed, *cluster) / float(1 << 32)
    drawn = stars.where(n >= 2).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), take - 1)))
    drawn = drawn.withColumn("__i", F.floor((F.col("__k") + start) * F.col("__all") / take) - (F.col("__end") - F.col("__p"))).where("__i >= 0 and __i < __p")
    drawn = drawn.withColumn("__b", F.floor((F.sqrt(8 * F.col("__i") + 1) + 1) / 2).cast("long"))
    drawn = drawn.select(*cluster, rating, F.expr("__i - __b * (__b - 1) div 2 + 1").alias("__a"), (F.col("__b") + 1).alias("__b"))
    member = lambda c, out: ranked.select(*cluster, rating, F.col("__r").alias(c), F.col(key).alias(out))
    pairs = match(match(drawn, member("__a", "__x"), [*cluster, rating, "__a"]), member("__b", "__y"), [*cluster, rating, "__b"])
    out = pairs.select(*cluster, rating, F.least("__x", "__y").alias(f"{key}_i"), F.greatest("__x", "__y").alias(f"{key}_j"))
    if total is not None:
        out = out.orderBy(hash_int(seed, f"{key}_i", f"{key}_j"), f"{key}_i", f"{key}_j").limit(total)
    return out


def restrict_pairs(pairs: DataFrame, multipliers: dict[str, float], min_cos: float | None = None, tops: str | None = None, min_gap: int = 0) -> DataFrame:
    """Source weight multipliers (0 removes), and for window pairs a minimum cosine and both / any ends being tops."""
    factor = F.lit(1.0)
    for name, m in sorted(multipliers.items()):
        factor = F.when(F.col("ptype") == name, F.lit(m)).otherwise(factor)
    d = pairs.withColumn("weight", F.col("weight") * factor).where(F.col("weight") > 0)
    window = F.col("ptype") == "window"
    if min_cos is not None:
        d = d.where(~window | (F.coalesce(F.col("cos"), F.lit(0.0)) >= min_cos))
    if tops == "both":
        d = d.where(~window | ((F.col("is_top_i") == 1) & (F.col("is_top_j") == 1)))
    elif tops == "any":
        d = d.where(~window | (F.col("is_top_i") == 1) | (F.col("is_top_j") == 1))
    return d.where(F.col("dstar") >= min_gap)


def cross_tier_pairs(items: DataFrame, event: str, seg, key: str, tier: str, vec: str, threshold: float) -> DataFrame:
    """Similar pairs with different tiers, winner first, item-balanced weights.

    Each event weighs the same, inside it each item that occurs, and an item's weight is split over its partners;
    a pair carries what both its ends give.  All weights sum to 1.
    """
    seg = as_list(seg)
    by = list(dict.fromkeys([event, *seg]))
    sim = similar_in_group(items, by, key, vec, threshold)
    p = attach_endpoints(sim, items, key, [tier]).where(F.col(f"{tier}_i") != F.col(f"{tier}_j"))
    up = F.col(f"{tier}_i") > F.col(f"{tier}_j")
    p = p.select(*by, F.when(up, F.col(f"{key}_i")).otherwise(F.col(f"{key}_j")).alias("winner"),
                 F.when(up, F.col(f"{key}_j")).otherwise(F.col(f"{key}_i")).alias("loser"), "cos")
    ends = p.select(event, F.explode(F.array("winner", "loser")).alias("__k"))
    degree = ends.groupBy(event, "__k").agg(F.count(F.lit(1)).alias("__deg"))
    per_event = degree.groupBy(event).agg(F.count(F.lit(1)).alias("__items"))
    events = per_event.agg(F.count(F.lit(1)).alias("__events"))
    for end in ("winner", "loser"):
        p = p.join(degree.select(event, F.col("__k").alias(end), F.col("__deg").alias(f"__deg_{end}")), [event, end])
    p = p.join(per_event, event).crossJoin(F.broadcast(events))  # one row
    weight = (1 / F.col("__deg_winner") + 1 / F.col("__deg_loser")) / F.col("__items") / F.col("__events")
    return p.select(*by, "winner", "loser", "cos", weight.alias("weight"))
