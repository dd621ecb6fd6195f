"""Ranking and classification metrics with exact treatment of tied scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import TIE_BLOCK, as_list, bind, checkpoint, hash_bucket, hash_int, is_number, match, prefix_totals, quantiles, rank_in_group, score_position, sorted_position, tie_blocks
from starfold.operators.clusters import representatives
from starfold.operators.joins import band_of, pairs_in_groups, similar_in_group
from starfold.operators.segments import standardise
from starfold.operators.summary import spearman

PAIR_EPS = 1e-8
POISSON_STEPS = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]  # distribution function of mean 1
ORDER_EPS = 1e-9
SMALL_BLOCK = 64
SMALL_RANK = 128


def required(value: str | Column, what: str) -> Column:
    """The value, or an error when it is missing or not finite: a metric over part of its rows would look like one over all."""
    c = F.col(value) if isinstance(value, str) else value
    finite = is_number(c) & (F.abs(c.cast("double")) < math.inf)
    return F.when(finite, c).otherwise(F.raise_error(F.lit(f"missing or non-finite {what}")))


def scored(items: DataFrame, *scores: str) -> DataFrame:
    """Items whose scores are checked where they are used."""
    return items.withColumns({s: required(s, f"score {s}") for s in scores})


# --- pairs -------------------------------------------------------------------------------------------------------


def pair_outcomes(pairs: DataFrame, scores: DataFrame, key: str, score: str, eps: float = PAIR_EPS) -> DataFrame:
    """M1: add ``outcome``: 1 when the winner scores higher, 0.5 within ``eps``, 0 otherwise.

    An end without a finite score is an error, as accuracies over the other pairs only would not be comparable.
    """
    side = lambda end: scores.select(F.col(key).alias(end), F.col(score).alias(f"__{end}"))
    j = pairs.join(side("winner"), "winner", "left").join(side("loser"), "loser", "left")
    return add_outcome(j, "__winner", "__loser", eps, f"score {score}").drop("__winner", "__loser")


def add_outcome(pairs: DataFrame, winner: str, loser: str, eps: float = PAIR_EPS, what: str = "score") -> DataFrame:
    """M1: ``outcome`` of pairs that carry the scores of both ends, so no pair is shuffled to fetch them."""
    d = required(winner, what) - required(loser, what)
    return pairs.withColumn("outcome", F.when(F.abs(d) <= eps, 0.5).when(d > 0, 1.0).otherwise(0.0))


def pair_metrics(outcomes: DataFrame, by) -> DataFrame:
    """M1/M2: pairs, correct, wrong, ties and accuracy per group (event, type, gap, domain)."""
    o = F.col("outcome")
    return outcomes.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(o == 1).alias("correct"), F.count_if(o == 0).alias("wrong"),
        F.count_if(o == 0.5).alias("ties"), F.avg(o).alias("accuracy"))


def pair_summary(outcomes: DataFrame, event) -> DataFrame:
    """M1: one row: pooled accuracy, event-macro accuracy, pairs and events."""
    g = outcomes.groupBy(*as_list(event)).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("s"))
    return g.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("events"), F.try_divide(F.sum("s"), F.sum("n")).alias("pooled"),
                 F.avg(F.col("s") / F.col("n")).alias("event_macro"))


def with_domain(pairs: DataFrame, items: DataFrame, key: str, event: str) -> DataFrame:
    """M2: same-event or cross-event domain and the unordered event-pair key."""
    side = lambda end: items.select(F.col(key).alias(end), F.col(event).alias(f"__{end}"))
    j = pairs.join(side("winner"), "winner").join(side("loser"), "loser")
    return add_domain(j, "__winner", "__loser").drop("__winner", "__loser")


def add_domain(pairs: DataFrame, winner: str, loser: str) -> DataFrame:
    """M2: domain and event-pair key of pairs that carry the events of both ends."""
    same = F.when(F.col(winner) == F.col(loser), "same_event").otherwise("cross_event")
    return pairs.withColumns({"domain": same, "event_pair": F.to_json(F.array_sort(F.array(winner, loser)))})


# --- complete ranking --------------------------------------------------------------------------------------------


def _harmonic(n: Column) -> Column:
    """n-th harmonic number: exact table for small n, asymptotic series (error below 1e-15) beyond."""
    small, total = [0.0], 0.0
    for k in range(1, SMALL_RANK + 1):
        total += 1 / k
        small.append(total)
    x = n.cast("double")
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4))
    table = F.element_at(F.array(*[F.lit(v) for v in small]), (F.least(n, F.lit(SMALL_RANK)) + 1).cast("int"))
    return F.when(n <= SMALL_RANK, table).otherwise(series)


def _harmonic_step(a: Column, s: Column) -> Column:
    """H(a+s) - H(a) without cancellation for large a."""
    x, y = a.cast("double"), (a + s).cast("double")
    tail = lambda v: 1 / (2 * v) - 1 / (12 * v * v) + 1 / (120 * F.pow(v, 4))
    return F.when(a >= SMALL_RANK, F.log1p(s / x) + tail(y) - tail(x)).otherwise(_harmonic(a + s) - _harmonic(a))


def _block_precision(n: Column, g: Column, a: Column, h: Column) -> Column:
    """Expected sum of precisions at the positives of a tie block of ``n`` rows with ``g`` positives after ``a`` rows with ``h``.

    The block is in uniformly random order.  Short blocks are summed, long ones use harmonic numbers, so a block
    holding a third of the table costs the same as any other.
    """
    n1 = F.when(n > 1, n - 1).otherwise(1)
    slope = F.when(n > 1, (g - 1) / n1).otherwise(1.0)
    short = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(SMALL_BLOCK)) - 1), F.lit(0.0), lambda s, o: s + (h + 1 + o * slope) / (a + o + 1))
    long = slope * n + (h + 1 - slope * (a + 1)) * _harmonic_step(a, n)
    return F.when(g == 0, 0.0).otherwise(g / n * F.when(n <= SMALL_BLOCK, short).otherwise(long))


def average_precision(items: DataFrame, by, label: dict[str, Column] | Column, score: str, blocks: DataFrame | None = None) -> DataFrame:
    """M3/M4: per group (and threshold name, if several labels): AP with tied blocks uniformly shuffled, AUC with half
    ties, analytic random AP, closure.  Groups without positives give NULL metrics; a missing score is an error.
    ``blocks`` are the ``label_blocks`` of a single label, if they are there already.
    """
    by = as_list(by)
    labels = label if isinstance(label, dict) else {"": label}
    names = {f"pos{i}": k for i, k in enumerate(labels)} if blocks is None else {"pos": ""}
    if blocks is None:
        blocks = tie_blocks(scored(items, score), by, score, {p: F.when(labels[k], 1).otherwise(0) for p, k in names.items()})
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("threshold"), F.col(p).alias("__hit"), F.col(f"{p}_above").alias("__before"), F.col(f"{p}_total").alias("__all")) for p, k in names.items()]))
    b = blocks.select(*by, F.col("n").alias("__n"), F.col("n_above").alias("__a"), F.col("n_total").alias("__items"), rows.alias("__x")).select(*by, "__n", "__a", "__items", "__x.*")
    n_block, hit, above, before = F.col("__n"), F.col("__hit"), F.col("__a"), F.col("__before")
    below = F.col("__items") - above - n_block - (F.col("__all") - before - hit)
    g = b.groupBy(*by, "threshold").agg(
        F.first("__items").alias("items"), F.first("__all").alias("positives"),
        F.sum(_block_precision(n_block, hit, above, before)).alias("__c"),
        F.sum(hit * (below + 0.5 * (n_block - hit))).alias("__w"))
    n, p = F.col("items"), F.col("positives")
    rnd = F.when(n > 1, (_harmonic(n) + (p - 1) * (n - _harmonic(n)) / F.when(n > 1, n - 1).otherwise(1)) / n).otherwise(1.0)
    ok = p > 0
    out = g.select(
        *by, "threshold", "items", "positives", (p / n).alias("prevalence"), F.when(ok, F.try_divide("__c", p)).alias("ap"),
        F.when(ok, rnd).alias("random_ap"), F.when(ok, F.try_divide("__w", p * (n - p))).alias("auc"))
    out = out.withColumn("ap_closure", F.try_divide(F.col("ap") - F.col("random_ap"), 1 - F.col("random_ap")))
    return out if isinstance(label, dict) else out.drop("threshold")


def ranking_metrics(per_event: DataFrame, threshold: str = "threshold") -> DataFrame:
    """M4: per threshold: events, events with positives, macro AP / AUC / random AP / closure, item-weighted AP."""
    g = per_event.groupBy(threshold).agg(
        F.count(F.lit(1)).alias("events"), F.count("ap").alias("events_with_positives"), F.avg("ap").alias("ap_macro"),
        F.avg("random_ap").alias("random_ap_macro"), F.avg("prevalence").alias("prevalence_macro"), F.avg("auc").alias("auc_macro"),
        F.try_divide(F.sum(F.col("ap") * F.col("items")), F.sum(F.when(F.col("ap").isNotNull(), F.col("items")))).alias("ap_item_weighted"))
    return g.withColumn("ap_closure", F.try_divide(F.col("ap_macro") - F.col("random_ap_macro"), 1 - F.col("random_ap_macro")))


def budget_metrics(items: DataFrame, by, label: Column, score: str, fractions: list[float], rounding: str = "ceil", blocks: DataFrame | None = None) -> DataFrame:
    """M5: expected hits in the top budget with the boundary block taken uniformly, precision, recall, random and ceiling.

    ``rounding`` is ``ceil`` (current) or ``even`` (legacy banker's rounding, at least one).  A missing score is an error.
    ``blocks`` are the ``label_blocks``, if they are there already.
    """
    by = as_list(by)
    blocks = label_blocks(items, by, label, score) if blocks is None else blocks
    b = blocks.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    size = F.ceil(F.col("n_total") * F.col("fraction")) if rounding == "ceil" else F.greatest(F.lit(1), F.bround(F.col("n_total") * F.col("fraction")))
    b = b.withColumn("budget", size.cast("long")).where((F.col("n_above") < F.col("budget")) & (F.col("budget") <= F.col("n_above") + F.col("n")))
    hits = F.col("pos_above") + F.col("pos") * (F.col("budget") - F.col("n_above")) / F.col("n")
    b = b.withColumn("hits", hits.cast("double"))
    n, p, k = F.col("n_total"), F.col("pos_total"), F.col("budget")
    top = F.least(k, p)
    return b.select(
        *by, "fraction", n.alias("items"), "budget", p.alias("positives"), "hits", (F.col("hits") / k).alias("precision"),
        F.try_divide("hits", p).alias("recall"), (p / n).alias("random_precision"), F.when(p > 0, k / n).alias("random_recall"),
        (top / k).alias("precision_ceiling"), F.try_divide(top, p).alias("recall_ceiling"))


def budget_summary(per_event: DataFrame) -> DataFrame:
    """M6: macro and pooled precision and recall per fraction."""
    return per_event.groupBy("fraction").agg(
        F.count(F.lit(1)).alias("events"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("random_recall").alias("random_recall_macro"), F.avg("recall_ceiling").alias("recall_ceiling_macro"),
        F.try_divide(F.sum("hits"), F.sum("budget")).alias("precision_pooled"), F.try_divide(F.sum("hits"), F.sum("positives")).alias("recall_pooled"))


def positive_positions(items: DataFrame, by, label: Column, score: str, key: str, blocks: DataFrame | None = None, tie_block: int = TIE_BLOCK) -> DataFrame:
    """Every positive with its position among all items (``__pos``) and among the positives (``__k``): both, and the group.

    ``blocks`` are the ``label_blocks`` of the items, if they are there already.  Where all items of a block are positive, the
    block alone tells the positions of its members.  The items of blocks with both kinds, and of blocks above ``tie_block`` rows,
    are ranked by hash, the latter in hash buckets.
    """
    by = as_list(by)
    d = scored(items.select(*by, key, score, label.alias("__l")), score)
    if blocks is None:
        blocks = checkpoint(label_blocks(d, by, F.col("__l"), score))
    told = (F.col("pos") == F.col("n")) & (F.col("n") <= tie_block)
    at = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__at")
    pure = blocks.where(told).select(*by, "n_above", "pos_above", at)
    pure = pure.select(*by, (F.col("n_above") + F.col("__at")).alias("__pos"), (F.col("pos_above") + F.col("__at")).alias("__k"))
    mixed = blocks.where((F.col("pos") > 0) & ~told).select(*by, score, "n_above", "pos_above", (F.col("n") > tie_block).alias("__big"))
    d = match(d, mixed, [*by, score]).withColumn("__h", hash_int("tie", key)).withColumn("__p", F.when(F.col("__l"), 1).otherwise(0))
    d = d.withColumn("__b", F.when(F.col("__big"), hash_bucket(F.col("__h")).cast("long")).otherwise(0))
    inside = prefix_totals(d.where("__big"), [*by, score], "__b", {"__rows": F.lit(1), "__hits": F.col("__p")})
    d = match(d, inside, [*by, score, "__b"], "left")
    w = W.partitionBy(*by, score, "__b").orderBy("__h", key)
    d = d.select(*by, "__l", (F.col("n_above") + F.coalesce("__rows", F.lit(0)) + F.row_number().over(w)).alias("__pos"),
                 (F.col("pos_above") + F.coalesce("__hits", F.lit(0)) + F.sum("__p").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("__k"))
    return pure.unionByName(d.where("__l").drop("__l"))


def label_blocks(items: DataFrame, by, label: Column, score: str) -> DataFrame:
    """Tie blocks with the sum ``pos`` of the label, as several metrics read them; a missing score is an error."""
    return tie_blocks(scored(items, score), by, score, {"pos": F.when(label, 1).otherwise(0)})


def recall_curve(items: DataFrame, by, label: Column, score: str, key: str, target: float = 0.8, positions: DataFrame | None = None) -> DataFrame:
    """M7: list share and purity where recall first reaches the target (ties in hash order of the key)."""
    by = as_list(by)
    k = positive_positions(items, by, label, score, key) if positions is None else positions
    totals = items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_if(label).alias("positives"))
    return match(k, totals, by).where(F.col("__k") == F.ceil(F.col("positives") * target)).select(
        *by, "items", "positives", (F.col("__pos") / F.col("items")).alias("list_share"), (F.col("__k") / F.col("__pos")).alias("purity"))


def sequential_ap(items: DataFrame, by, label: Column, score: str, key: str, positions: DataFrame | None = None) -> DataFrame:
    """Legacy AP: one fixed order, ties by hash of the key."""
    by = as_list(by)
    k = positive_positions(items, by, label, score, key) if positions is None else positions
    return k.groupBy(*by).agg(F.avg(F.col("__k") / F.col("__pos")).alias("ap"))


def structure_ceiling(items: DataFrame, by, label: Column, fraction: float) -> DataFrame:
    """M8: best recall that any order can reach in the budget, from prevalence alone."""
    g = items.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("items"), F.count_if(label).alias("positives"))
    return g.withColumn("max_recall", F.least(F.lit(1.0), F.try_divide(F.lit(fraction) * F.col("items"), F.col("positives"))))


def legacy_cluster_budget(items: DataFrame, event: str, cluster: str, key: str, rating: str, score: str, rep_score: str,
                          fractions: list[float], group_max: bool = False, k: int = 4) -> DataFrame:
    """M9: one representative per cluster (ties by SHA-256 of the id), top budget, hits by item, cluster and singleton."""
    items = scored(items, score, rep_score)
    tie = F.sha2(F.col(key).cast("string"), 256)
    reps = representatives(items, event, cluster, key, rep_score, score, group_max, tie).withColumn("__t", tie)
    reps = sorted_position(reps, [event], [F.col("rank_score").desc(), "__t"], "__pos")
    stars = items.select(event, key, F.col(rating).alias("__r"))
    pos_cl = items.groupBy(event, cluster).agg(F.count_if(F.col(rating) >= k).alias("__p"), F.count(F.lit(1)).alias("__n"))
    r = match(match(reps, stars, [event, key]), pos_cl, [event, cluster])
    tot = pos_cl.groupBy(event).agg(
        F.sum("__n").alias("items"), F.count(F.lit(1)).alias("groups"), F.sum("__p").alias("positive_items"), F.count_if(F.col("__p") > 0).alias("positive_groups"),
        F.count_if((F.col("__p") > 0) & (F.col("__n") == 1)).alias("positive_singletons"))
    f = tot.withColumn("fraction", F.explode(F.array(*[F.lit(float(x)) for x in fractions]))).withColumn("budget", F.ceil(F.col("items") * F.col("fraction")))
    hit = F.col("__pos") <= F.col("budget")
    keys = [event, "fraction", "budget", "items", "groups", "positive_items", "positive_groups", "positive_singletons"]
    return match(r, f, event).groupBy(*keys).agg(
        F.count_if(hit).alias("kept"), F.count_if(hit & (F.col("__r") >= k)).alias("item_hits"), F.count_if(hit & (F.col("__p") > 0)).alias("group_hits"),
        F.count_if(hit & (F.col("__r") >= k) & (F.col("__n") == 1)).alias("singleton_hits"))


# --- local exams -------------------------------------------------------------------------------------------------


def selection_probability(members: DataFrame, gid: str, score: str, acceptable: Column, k: int, out: str, eps: float = PAIR_EPS) -> DataFrame:
    """Per group the probability that the top ``k`` contain an acceptable member, boundary ties uniform.

    The boundary score comes from the group's tie blocks, so a group may have any size.
    """
    d = scored(members, score).select(gid, F.col(score).cast("double").alias("__s"), acceptable.alias("__g"))
    edge = tie_blocks(d, gid, "__s").withColumn("__k", F.least(F.lit(k), F.col("n_total")))
    edge = edge.where((F.col("n_above") < F.col("__k")) & (F.col("__k") <= F.col("n_above") + F.col("n"))).select(gid, "__k", F.col("__s").alias("__b"))
    above = F.col("__s") > F.col("__b") + eps
    tied = F.abs(F.col("__s") - F.col("__b")) <= eps
    g = match(d, edge, gid).groupBy(gid, "__k").agg(
        F.count_if(above).alias("a"), F.count_if(tied).alias("t"), F.count_if(tied & ~F.col("__g")).alias("bad"),
        F.count_if(above & F.col("__g")).alias("sure"), F.count_if(F.col("__g")).alias("good"))
    rem = F.col("__k") - F.col("a")
    miss = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(rem, F.lit(1)) - 1), F.lit(1.0), lambda s, j: s * (F.col("bad") - j) / (F.col("t") - j))
    p = F.when(F.col("good") == 0, 0.0).when(F.col("sure") > 0, 1.0).when(F.col("bad") >= rem, 1.0 - miss).otherwise(1.0)
    return g.select(gid, p.alias(out))


def local_details(labels: DataFrame, gid: str, key: str, event: str, star: str, score: str) -> DataFrame:
    """Per group with a non-zero top: best1, best2, accepted_top2 and their random baselines."""
    w = W.partitionBy(gid)
    rank = F.row_number().over(w.orderBy(F.col(star).desc(), key))
    d = labels.withColumn("__r", rank).withColumn("__top", F.max(star).over(w)).withColumn("__second", F.max(F.when(F.col("__r") == 2, F.col(star))).over(w))
    d = d.where("__top > 0").withColumn("__best", F.col(star) == F.col("__top")).withColumn("__acc", F.col(star) >= F.col("__second")).withColumn("__zero", F.lit(0.0))
    d = checkpoint(d.select(gid, key, event, score, "__zero", "__best", "__acc"))
    base = d.groupBy(gid).agg(
        F.first(event).alias("event"), F.count(F.lit(1)).alias("size"), F.count_if(F.col("__best")).alias("__nb"), F.count_if(F.col("__acc")).alias("__na"),
        F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("members"))
    out = base.withColumn("unique_best", F.col("__nb") == 1).withColumn("random_best1", F.col("__nb") / F.col("size")).withColumn("random_accepted_top2", F.col("__na") / F.col("size"))
    for name, s, ok, k in (("best1", score, "__best", 1), ("best2", score, "__best", 2), ("accepted_top2", score, "__acc", 1), ("random_best2", "__zero", "__best", 2)):
        out = out.join(selection_probability(d, gid, s, F.col(ok), k, name), gid)
    return out.drop("__nb", "__na")


LOCAL_FIELDS = ["best1", "best2", "accepted_top2", "random_best1", "random_best2", "random_accepted_top2"]


def kept2() -> Column:
    """Mean number of items that a budget of two keeps per group."""
    return F.avg(F.least(F.col("size"), F.lit(2))).alias("mean_kept2")


def local_metrics(details: DataFrame) -> DataFrame:
    """Rows unique_best / tied_best / all_nonzero / member_set_balanced with means, the mean number of items that a budget of
    two keeps and the event macro of best1.  The groups of member_set_balanced are the distinct member sets."""
    details = checkpoint(details)
    scope = F.explode(F.array(F.when(F.col("unique_best"), "unique_best").otherwise("tied_best"), F.lit("all_nonzero")))
    d = details.withColumn("scope", scope)
    macro = d.groupBy("scope", "event").agg(F.avg("best1").alias("m")).groupBy("scope").agg(F.avg("m").alias("best1_event_macro"))
    main = d.groupBy("scope").agg(F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in LOCAL_FIELDS], kept2()).join(macro, "scope")
    sets = details.where("unique_best").groupBy("members").agg(*[F.avg(c).alias(c) for c in LOCAL_FIELDS])
    none = F.lit(None).cast("double")
    balanced = sets.agg(F.lit("member_set_balanced").alias("scope"), F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in LOCAL_FIELDS], none.alias("mean_kept2"), none.alias("best1_event_macro"))
    return main.unionByName(balanced)


def local_by_event(details: DataFrame) -> DataFrame:
    """The means of the groups with one best item, per event."""
    return details.where("unique_best").groupBy("event").agg(F.count(F.lit(1)).alias("groups"), *[F.avg(c).alias(c) for c in LOCAL_FIELDS], kept2())


def local_inputs(labels: DataFrame, gid: str, key: str, star: str) -> DataFrame:
    """One row: groups given, distinct items, places taken by items seen before, and groups without a star above zero.

    A group whose stars are all missing counts as one without a star.
    """
    groups = labels.groupBy(gid).agg(F.max(star).alias("__top")).agg(
        F.count(F.lit(1)).alias("input_groups"), F.count_if(F.coalesce(F.col("__top") <= 0, F.lit(True))).alias("all_zero_ambiguous"))
    items = labels.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.count(key).alias("unique_items"), F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("__n") - 1)), F.lit(0)).alias("repeated_slots"))
    return groups.crossJoin(items)  # two one-row frames


# --- fusion ------------------------------------------------------------------------------------------------------


def rank_sum(items: DataFrame, by, key: str, scores: list[str], out: str = "fused") -> DataFrame:
    """Sum of average-tie ranks inside the group."""
    items = scored(items, *scores)
    for i, s in enumerate(scores):
        items = rank_in_group(items, by, s, f"__rank{i}")
    total = sum((F.col(f"__rank{i}") for i in range(1, len(scores))), F.col("__rank0"))
    return items.withColumn(out, total).drop(*[f"__rank{i}" for i in range(len(scores))])


def weighted_blend(items: DataFrame, by, weights: dict[str, float], out: str = "fused") -> DataFrame:
    """Weighted sum of z-scores with global (no ``by``) or group scope."""
    for i, s in enumerate(weights):
        items = standardise(items, by, s, f"__z{i}")
    total = sum((F.col(f"__z{i}") * w for i, w in enumerate(weights.values())), F.lit(0.0))
    return items.withColumn(out, total).drop(*[f"__z{i}" for i in range(len(weights))])


def greedy_blend(pairs: DataFrame, items: DataFrame, key: str, scores: list[str], steps: int = 6, min_gain: float = 1e-4) -> DataFrame:
    """Forward selection with repetition on pair accuracy; one job per step scores all candidates.

    The pair table with z-score differences is checkpointed once.  Returns ``(score, weight, step, objective)`` rows.
    """
    z = items
    for s in scores:
        z = standardise(z, [], s, f"z_{s}")
    zc = [f"z_{s}" for s in scores]
    side = lambda end: z.select(F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in zc])
    diff = pairs.select("winner", "loser").join(side("winner"), "winner").join(side("loser"), "loser")
    diff = checkpoint(diff.select(*[(F.col(f"{c}_winner") - F.col(f"{c}_loser")).alias(c) for c in zc]))
    chosen, best, log = [], -1.0, []
    for _ in range(steps):
        base = sum((F.col(c) for c in chosen), F.lit(0.0))
        trial = diff.agg(*[F.avg(F.when(F.abs(base + F.col(c)) <= PAIR_EPS, 0.5).when(base + F.col(c) > 0, 1.0).otherwise(0.0)).alias(c) for c in zc]).first()
        name = max(zc, key=lambda c: (trial[c], -zc.index(c)))
        if trial[name] <= best + min_gain:
            break
        chosen.append(name)
        best = trial[name]
        log.append((name[2:], len(log) + 1, float(best)))
    return items.sparkSession.createDataFrame(log, "score string, step int, objective double")


def conditional_blend(exam: DataFrame, base: str, expert: str, cos: str, threshold: float, out: str = "score") -> DataFrame:
    """The expert's score inside very similar groups, the base score elsewhere; valid per (group, item) only."""
    use = F.coalesce(F.col(cos) >= threshold, F.lit(False))
    return exam.withColumn(out, F.when(use, F.col(expert)).otherwise(F.col(base))).withColumn("expert", use.cast("int"))


# --- classes -----------------------------------------------------------------------------------------------------


def confusion(items: DataFrame, by, truth: Column, probs: str, classes: int = 4) -> DataFrame:
    """Completed truth x prediction counts per group; prediction = first maximum."""
    by = as_list(by)
    pred = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    c = items.select(*by, truth.cast("int").alias("truth"), pred.alias("pred")).groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    axis = F.array(*[F.lit(k) for k in range(classes)])
    groups = c.select(*by).distinct() if by else items.sparkSession.range(1).select()
    grid = groups.withColumn("truth", F.explode(axis)).withColumn("pred", F.explode(axis))
    return grid.join(c, [*by, "truth", "pred"], "left").fillna(0, ["n"])


def classification_metrics(conf: DataFrame, by, classes: int = 4) -> DataFrame:
    """Per group accuracy, balanced and majority accuracy, top-class precision and recall from a confusion table."""
    by = as_list(by)
    d = lambda k: F.sum(F.when((F.col("truth") == k) & (F.col("pred") == k), F.col("n")).otherwise(0))
    t = lambda k: F.sum(F.when(F.col("truth") == k, F.col("n")).otherwise(0))
    p = lambda k: F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0))
    g = conf.groupBy(*by).agg(F.sum("n").alias("items"), *[x for k in range(classes) for x in (d(k).alias(f"d{k}"), t(k).alias(f"t{k}"), p(k).alias(f"p{k}"))])
    recalls = [F.try_divide(f"d{k}", f"t{k}") for k in range(classes)]
    seen = sum(((F.col(f"t{k}") > 0).cast("int") for k in range(1, classes)), (F.col("t0") > 0).cast("int"))
    total = sum((F.coalesce(r, F.lit(0.0)) for r in recalls[1:]), F.coalesce(recalls[0], F.lit(0.0)))
    hit = sum((F.col(f"d{k}") for k in range(1, classes)), F.col("d0"))
    last = classes - 1
    return g.select(
        *by, "items", (hit / F.col("items")).alias("accuracy"), F.try_divide(total, seen).alias("balanced_accuracy"),
        (F.greatest(*[f"t{k}" for k in range(classes)]) / F.col("items")).alias("majority_accuracy"),
        *[recalls[k].alias(f"recall_{k}") for k in range(classes)], *[F.try_divide(f"d{k}", f"p{k}").alias(f"precision_{k}") for k in range(classes)],
        F.col(f"p{last}").alias("selected"), F.col(f"d{last}").alias("selected_hits"))


def order_inversion(labels: DataFrame, gid: str, key: str, star: str, score: str, eps: float = ORDER_EPS, by=None) -> DataFrame:
    """Wrong-order pairs by class (hard: gap >= 2, soft: gap 1, champion: an end is the group's pick), and groups with one."""
    by = as_list(by)
    top = labels.groupBy(gid).agg(F.min(F.struct((-F.col(star)).alias("s"), key))[key].alias("__c"))
    p = pairs_in_groups(labels, [gid, *by], key, [star, score]).where(F.col(f"{star}_i") != F.col(f"{star}_j")).join(top, gid)
    ds = F.col(f"{score}_i") - F.col(f"{score}_j")
    du = F.col(f"{star}_i") - F.col(f"{star}_j")
    inv = ((du > 0) != (ds > 0)) & (F.abs(ds) > eps)
    champ = (F.col("__c") == F.col(f"{key}_i")) | (F.col("__c") == F.col(f"{key}_j"))
    kinds = F.array_compact(F.array(F.when(F.abs(du) >= 2, "hard").otherwise("soft"), F.when(champ, "champion")))
    per = p.select(*by, gid, inv.alias("inv"), F.explode(kinds).alias("kind")).groupBy(*by, gid, "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("inv")).alias("k"))
    return per.groupBy(*by, "kind").agg(
        F.sum("n").alias("pairs"), F.sum("k").alias("inversions"), F.count_if(F.col("k") > 0).alias("groups"), F.try_divide(F.sum("k"), F.sum("n")).alias("rate"))


# --- exam picks --------------------------------------------------------------------------------------------------


def _decided(labels: DataFrame, gid: str, key: str, star: str) -> DataFrame:
    """Groups with a unique non-zero top: top star, second star and gap."""
    w = W.partitionBy(gid).orderBy(F.col(star).desc(), key)
    r = labels.select(gid, star, F.row_number().over(w).alias("__r")).where("__r <= 2")
    g = r.groupBy(gid).agg(F.max(F.when(F.col("__r") == 1, F.col(star))).alias("top"), F.max(F.when(F.col("__r") == 2, F.col(star))).alias("second"))
    return g.where("top > 0 and top > second").withColumn("gap", F.col("top") - F.col("second"))


def exam_profile(labels: DataFrame, gid: str, key: str, star: str, signal: str, fallback: str, gates: list[float | None]) -> DataFrame:
    """Picks of a gated rule: the member with the smallest signal if the two smallest differ by at least the gate,
    else the highest fallback score; a NULL gate never uses the signal.  Exact / <= 1 / top-two shares per rule and star gap.
    """
    place = F.row_number().over(W.partitionBy(gid).orderBy(F.col(signal).asc_nulls_last(), key))
    two = labels.select(gid, signal, place.alias("__p")).where("__p <= 2").groupBy(gid).agg(F.min(signal).alias("__v1"), F.max(signal).alias("__v2"), F.count(signal).alias("__nv"))
    g = labels.groupBy(gid).agg(
        F.min(F.when(F.col(signal).isNotNull(), F.struct(signal, key, star)))[star].alias("__sig"),
        F.min(F.when(F.col(fallback).isNotNull(), F.struct((-F.col(fallback)).alias("f"), key, star)))[star].alias("__fb"), F.count(fallback).alias("__nf"))
    d = _decided(labels, gid, key, star).join(g, gid).join(two, gid)
    d = d.withColumn("gate", F.explode(F.array(*[F.lit(x).cast("double") for x in gates])))
    far = F.when(F.col("__nv") >= 2, F.col("__v2") - F.col("__v1"))
    use = F.coalesce(far >= F.col("gate"), F.lit(False))
    pick = F.when(use, F.col("__sig")).when(F.col("__nf") >= 2, F.col("__fb"))
    d = d.withColumn("__dev", F.col("top") - pick).where(pick.isNotNull()).withColumn("__ok", (pick >= F.col("second")).cast("double")).withColumn("__use", use.cast("double"))
    d = d.withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col("gap") == 1, "gap1").otherwise("gap2+"))))
    return d.groupBy("gate", "slice").agg(
        F.count(F.lit(1)).alias("groups"), F.avg((F.col("__dev") == 0).cast("double")).alias("exact"), F.avg((F.col("__dev") <= 1).cast("double")).alias("within1"),
        F.avg("__ok").alias("top_two"), F.avg("__use").alias("signal_share"))


def win_rate_by_gap(pairs: DataFrame, items: DataFrame, key: str, signal: str, edges: list[float]) -> DataFrame:
    """Weighted share of pairs whose winner has the smaller signal, by band of the difference."""
    side = lambda end: items.select(F.col(key).alias(end), F.col(signal).alias(f"__{end}"))
    j = pairs.join(side("winner"), "winner").join(side("loser"), "loser").where("__winner is not null and __loser is not null")
    j = j.withColumn("band", band_of(F.abs(F.col("__winner") - F.col("__loser")), edges)).where("band is not null")
    won = F.sum(F.when(F.col("__winner") < F.col("__loser"), F.col("weight")).otherwise(0.0))
    return j.groupBy("band").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").alias("weight"), F.try_divide(won, F.sum("weight")).alias("win_rate"))


def group_top1(items: DataFrame, group, key: str, rating: str, score: str, min_gap: int = 1) -> DataFrame:
    """Over groups whose ratings differ by >= ``min_gap``: how often the best score has the top rating, and chance."""
    group = as_list(group)
    g = items.groupBy(*group).agg(
        F.max(rating).alias("mx"), F.min(rating).alias("mn"), F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(rating).alias("r"))).alias("p"), F.count(F.lit(1)).alias("n"))
    top = items.join(g.select(*group, "mx"), group).where(F.col(rating) == F.col("mx")).groupBy(*group).agg(F.count(F.lit(1)).alias("nt"))
    d = g.join(top, group).where(F.col("mx") - F.col("mn") >= min_gap)
    return d.agg(F.count(F.lit(1)).alias("groups"), F.avg((F.col("p.r") == F.col("mx")).cast("double")).alias("top1"), F.avg(F.col("nt") / F.col("n")).alias("chance"))


def group_spearman(items: DataFrame, group, rating: str, score: str, min_size: int = 5) -> DataFrame:
    """Mean and deviation of the per-group rank correlation over groups with enough items and varying ratings."""
    group = as_list(group)
    d = items.withColumn("__r", F.col(rating).cast("double"))
    r = spearman(d, group, "__r", score).where((F.col("n") >= min_size) & F.col("spearman").isNotNull() & ~F.isnan("spearman"))
    return r.agg(F.avg("spearman").alias("mean"), F.stddev_pop("spearman").alias("std"), F.count(F.lit(1)).alias("groups"))


def quota_recall(items: DataFrame, group, key: str, rating: str, score: str, fraction: float = 0.125, k: int = 3) -> DataFrame:
    """Recall of items rated >= k among the top ``max(1, round-half-even(fraction * n))`` of every group."""
    group = as_list(group)
    sizes = items.groupBy(*group).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction)).alias("__q"))
    r = score_position(items.select(*group, key, rating, score), group, score, key, "__pos").join(sizes, group)
    got = F.count_if((F.col("__pos") <= F.col("__q")) & (F.col(rating) >= k))
    return r.agg(got.alias("hits"), F.count_if(F.col(rating) >= k).alias("positives")).withColumn("recall", F.try_divide("hits", "positives"))


def star_tolerance(items: DataFrame, split: str, train: str, evaluate: str, rating: str, score: str, clean: str) -> DataFrame:
    """Scores cut to 0-5 at the training quantiles of the cumulative star shares; exact / within 1 / within 2."""
    tr = items.where(F.col(split) == train)
    shares = tr.agg(*[F.avg((F.col(rating) <= k).cast("double")).alias(f"q{k}") for k in range(5)])
    th = quantiles(tr, [], score, {f"th{k}": f"q{k}" for k in range(5)}, shares)
    ev = items.where(F.col(split) == evaluate).crossJoin(F.broadcast(th))  # one row
    star = sum(((F.col(score) > F.col(f"th{k}")).cast("int") for k in range(1, 5)), (F.col(score) > F.col("th0")).cast("int"))
    err = F.abs(star - F.col(rating))
    return ev.select(F.when(F.col(clean) == 1, "clean").otherwise("ordinary").alias("scope"), err.alias("e")).groupBy("scope").agg(
        F.count(F.lit(1)).alias("items"), F.avg((F.col("e") == 0).cast("double")).alias("exact"), F.avg((F.col("e") <= 1).cast("double")).alias("within1"),
        F.avg((F.col("e") <= 2).cast("double")).alias("within2"))


def band_accuracy(items: DataFrame, seg, key: str, vec: str, rating: str, score: str, edges: list[float], boundaries: list[int]) -> DataFrame:
    """Accuracy on similar pairs of a segment that cross a rating boundary, by cosine band."""
    p = similar_in_group(items, seg, key, vec, edges[0], [rating, score]).withColumn("band", band_of(F.col("cos"), edges)).where("band is not null")
    p = p.withColumn("boundary", F.explode(F.array(*[F.lit(k) for k in boundaries])))
    p = p.where((F.col(f"{rating}_i") >= F.col("boundary")) != (F.col(f"{rating}_j") >= F.col("boundary")))
    m = (F.col(f"{score}_i") - F.col(f"{score}_j")) * F.when(F.col(f"{rating}_i") > F.col(f"{rating}_j"), 1).otherwise(-1)
    return p.groupBy("boundary", "band").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(m > 0, 1.0).when(m == 0, 0.5).otherwise(0.0)).alias("accuracy"))


def bootstrap_by_event(a: DataFrame, b: DataFrame, event, value: str, draws: int = 10_000, seed: str = "boot") -> DataFrame:
    """Paired event differences a - b: mean, 95% bootstrap interval, positive events.

    An event is in a draw as often as a Poisson variable of mean 1 says, from a hash of both, and a draw's mean is taken over
    those it has (the Poisson bootstrap).  Counts are combined map-side, one row per draw and task is shuffled.  An event on one side
    only is an error; events with an undefined value on a side are left out on both.
    """
    event = as_list(event)
    side = lambda df, c: df.select(*event, F.lit(True).alias(f"{c}_in"), F.col(value).alias(c))
    d = side(a, "__a").withColumn("__k", F.struct(*event)).join(side(b, "__b").select(F.struct(*event).alias("__k"), "__b_in", "__b"), "__k", "full")
    both = F.col("__a_in") & F.col("__b_in")
    # checked and written before the filter on values, which would turn the full join into an inner one
    checked = F.when(F.coalesce(both, F.lit(False)), F.col("__a") - F.col("__b")).otherwise(F.raise_error(F.lit("an event is only on one side")))
    d = checkpoint(d.select(F.col("__k.*"), checked.alias("__d"))).where("__d is not null")
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in event])
    d = d.select(name.alias("__e"), "__d")
    stats = d.agg(F.count(F.lit(1)).alias("events"), F.avg("__d").alias("mean"), F.count_if(F.col("__d") > 0).alias("positive_events"))
    # every event lists the draws in blocks; its count in a draw is Poisson, read off one hash per (event, draw)
    block = max(1, min(draws, 1000))
    ids = F.sequence(F.lit(0), F.lit(-(-draws // block) - 1))
    e = d.withColumn("__block", F.explode(ids)).withColumn("__draw", F.explode(F.sequence(F.col("__block") * block, F.least((F.col("__block") + 1) * block, F.lit(draws)) - 1)))
    u = (hash_int(seed, "__e", "__draw") + 0.5) / float(1 << 32)
    times = sum(((u >= c).cast("int") for c in POISSON_STEPS[1:]), (u >= POISSON_STEPS[0]).cast("int"))
    sums = e.withColumn("__n", times).groupBy("__draw").agg(F.sum("__n").alias("__m"), F.sum(F.col("__n") * F.col("__d")).alias("__s"))
    means = sums.where("__m > 0").select((F.col("__s") / F.col("__m")).alias("m"))
    return stats.crossJoin(quantiles(means, [], "m", {"low": 0.025, "high": 0.975}))  # two one-row frames


def agreement_two_truths(label_pairs: DataFrame, scores: DataFrame, key: str, score: str, old: str) -> DataFrame:
    """The same pairs against new labels: accuracy of the score and of the old labels, by star-gap stratum.

    ``label_pairs`` carries ``<old>_winner`` and ``<old>_loser``.
    """
    o = pair_outcomes(label_pairs, scores, key, score)
    d = F.col(f"{old}_winner") - F.col(f"{old}_loser")
    o = o.withColumn("old_outcome", F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)).withColumn("gap", F.least("dstar", F.lit(3)))
    return o.groupBy("gap").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("outcome").alias("score_accuracy"), F.avg("old_outcome").alias("old_accuracy"),
        F.avg(F.when(d != 0, F.col("outcome"))).alias("score_accuracy_old_decided"))


def auc_by_threshold(per_event: DataFrame) -> DataFrame:
    """Event AUC weighted by event size, per threshold."""
    return per_event.where("auc is not null").groupBy("threshold").agg(
        F.count(F.lit(1)).alias("events"), (F.sum(F.col("auc") * F.col("items")) / F.sum("items")).alias("auc"))


# Rational approximations of the normal distribution function and of its inverse (Abramowitz and Stegun 26.2.17, 26.2.23).
NORMAL_CDF = (0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429))
NORMAL_QUANTILE = ((2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308))


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def _density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function, error below 1e-7."""
    scale, terms = NORMAL_CDF
    t = 1 / (1 + scale * F.abs(x))
    tail = _density(x) * t * _polynomial(t, terms)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Inverse of ``normal_cdf``; one Newton step takes the approximation to an error below 1e-5.  NULL outside (0, 1)."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    upper = t - _polynomial(t, NORMAL_QUANTILE[0]) / _polynomial(t, NORMAL_QUANTILE[1])
    start = F.when(p >= 0.5, upper).otherwise(-upper)
    return F.when((p > 0) & (p < 1), bind(start, lambda x: x - (normal_cdf(x) - p) / _density(x)))


def required_auc(prevalence: str, budget: str, recall: float = 0.8) -> Column:
    """Ranking AUC needed to reach the recall in the budget under a two-normal model; NULL if out of reach.

    At the cut, the kept share is ``rate * recall + (1 - rate) * false``.  The false share gives the cut on the negatives' scale
    and the recall its distance to the positives' mean, so the distance of the means follows without a search.  At least 0.5;
    0.9995 and more, a budget below ``rate * recall``, and a prevalence of 0 or 1 are out of reach.
    """
    rate, share = F.col(prevalence), F.col(budget)
    false = F.try_divide(share - rate * recall, 1 - rate)
    apart = normal_quantile(1 - false) + normal_quantile(F.lit(recall))
    area = F.when(false >= 1, F.lit(0.5)).otherwise(F.greatest(F.lit(0.5), normal_cdf(apart / math.sqrt(2))))
    return F.when((rate > 0) & (rate < 1) & (false > 0) & (area < 0.9995), F.round(area, 3))


def pick_accuracy(sources: DataFrame, answers: DataFrame, gid: str, key: str, bucket: str) -> DataFrame:
    """Per source and stratum how often the top-scored member is the chosen one; ``answers`` has one ``pick`` per
    decided group (NULL for ties, which are left out)."""
    top = sources.groupBy("source", gid).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k")))["k"].alias("__p"), F.count(F.lit(1)).alias("__n"))
    j = top.where("__n >= 2").join(answers.where("pick is not null"), gid)
    j = j.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col(bucket).cast("string"))))
    return j.groupBy("source", "stratum").agg(F.count(F.lit(1)).alias("groups"), F.avg((F.col("__p") == F.col("pick")).cast("double")).alias("accuracy"))


def gap_closure(df: DataFrame, by, value: str, floor: str, ceiling: str) -> DataFrame:
    """Macro mean of (value - floor) / (ceiling - floor); events without room are skipped."""
    room = F.col(ceiling) - F.col(floor)
    ratio = F.when(room > 1e-9, (F.col(value) - F.col(floor)) / room)
    return df.groupBy(*as_list(by)).agg(F.count(ratio).alias("events"), F.avg(ratio).alias("closure"))


def selector_scores(items: DataFrame, event: str, cluster: str, key: str, rating: str, local: str, glob: str) -> DataFrame:
    """Every item under every ordering method, in long form ``(method, event, key, rating, score)``.

    Methods: random, cluster representative (local pick, ordered by the cluster's best global score, the others after),
    direct by each score, rank sum, perfect, one per cluster with perfect scores.
    """
    noise = hash_int("noise", key) / float(1 << 33)
    base = rank_sum(items, event, key, [local, glob], "__fused").withColumn("__perfect", F.col(rating) + noise)
    base = checkpoint(base.select(event, cluster, key, rating, local, glob, "__fused", "__perfect"))
    reps = representatives(base, event, cluster, key, local, glob, group_max=True).select(event, key, F.col("rank_score").alias("__rep"))
    ideal = representatives(base, event, cluster, key, "__perfect", "__perfect").select(event, key, F.col("rank_score").alias("__one"))
    w = base.join(reps, [event, key], "left").join(ideal, [event, key], "left")
    back = noise - 1e6
    methods = {
        "random": noise, "cluster_representative": F.coalesce(F.col("__rep") + noise * 1e-6, back), "direct_local": F.col(local), "direct_global": F.col(glob),
        "rank_sum": F.col("__fused"), "perfect": F.col("__perfect"), "one_per_cluster_perfect": F.coalesce(F.col("__one"), back)}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), s.cast("double").alias("score")) for m, s in methods.items()]))
    return w.select(event, key, rating, rows.alias("m")).select("m.method", event, key, rating, "m.score")


def selector_comparison(long: DataFrame, event: str, key: str, rating: str, k: int = 3, fraction: float = 0.125, legacy: bool = False) -> DataFrame:
    """Per method macro AP, its closure against random, precision and recall in the budget, list share at 80% recall."""
    by, label = ["method", event], F.col(rating) >= k
    long = checkpoint(long)
    blocks = checkpoint(label_blocks(long, by, label, "score"))
    positions = checkpoint(positive_positions(long, by, label, "score", key, blocks))
    ap = sequential_ap(long, by, label, "score", key, positions) if legacy else average_precision(long, by, label, "score", blocks).select(*by, "ap").where("ap is not null")
    bud = budget_metrics(long, by, label, "score", [fraction], "even" if legacy else "ceil", blocks).where("positives > 0")
    cur = recall_curve(long, by, label, "score", key, positions=positions)
    m = ap.groupBy("method").agg(F.count(F.lit(1)).alias("events"), F.avg("ap").alias("ap"))
    m = m.join(bud.groupBy("method").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall")), "method")
    m = m.join(cur.groupBy("method").agg(F.avg("list_share").alias("share_at_80"), F.avg("purity").alias("purity_at_80")), "method")
    rnd = m.where("method = 'random'").select(F.col("ap").alias("__r"))
    return m.crossJoin(F.broadcast(rnd)).withColumn("closure", F.try_divide(F.col("ap") - F.col("__r"), 1 - F.col("__r"))).drop("__r")  # one row
