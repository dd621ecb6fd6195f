"""From human labels to preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import as_list, hash_int, once, written
from starfold.functions.scalars import confidence_weight, hash_order
from starfold.operators.joins import cross_class_pairs, pairs_in_groups

# Share of the total weight per source.
SOURCE_SHARES = {"window": 0.5, "global": 0.25, "abs": 0.2, "golden": 0.05}


def group_verdict(labels: DataFrame, gid: str, key: str, star: str) -> DataFrame:
    """L1: per group the top star and status: unique top -> win, shared -> tie, all zero -> tie0; winner for win."""
    top = labels.groupBy(gid).agg(F.max(star).alias("top"))
    j = labels.join(top, gid).where(F.col(star) == F.col("top"))
    g = j.groupBy(gid).agg(F.first("top").alias("top"), F.count(F.lit(1)).alias("n_top"), F.min(key).alias("__w"))
    status = F.when(F.col("top") == 0, "tie0").when(F.col("n_top") > 1, "tie").otherwise("win")
    return g.select(gid, "top", "n_top", status.alias("status"), F.when(status == "win", F.col("__w")).alias("winner"))


def verdict_agreement(labels: DataFrame, gid: str, key: str, star: str, old: str) -> DataFrame:
    """L1: group counts per status and how often the pick carries the old top rating."""
    v = group_verdict(labels, gid, key, star)
    old_top = labels.groupBy(gid).agg(F.max(old).alias("__old_top"))
    pick = v.join(old_top, gid).join(labels.select(gid, F.col(key).alias("winner"), F.col(old).alias("__old")), [gid, "winner"], "left")
    return pick.groupBy("status").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("__old") == F.col("__old_top")).alias("agree"))


def label_pairs(labels: DataFrame, gid: str, key: str, star: str, cols: list[str] = ()) -> DataFrame:
    """L2: unequal stars inside a bounded group -> winner, loser, gap and confidence weight."""
    return label_pairs_of(labels, gid, key, {star: star}, cols, "__source").drop("__source")


def label_pairs_of(labels: DataFrame, gid: str, key: str, stars: dict[str, str], cols: list[str] = (), out: str = "source") -> DataFrame:
    """L2 for several ratings of the same items: ``out`` names the rating; the pairs of a group are formed once for all."""
    rated = list(dict.fromkeys(stars.values()))
    p = pairs_in_groups(labels, gid, key, [*rated, *[c for c in cols if c not in rated]])
    if len(stars) == 1:
        source, star = next(iter(stars.items()))
        p = p.withColumns({"__source": F.lit(source), "__a": F.col(f"{star}_i"), "__b": F.col(f"{star}_j")})
    else:
        p = p.withColumn("__s", F.explode(F.array(*[
            F.struct(F.lit(n).alias("__source"), F.col(f"{s}_i").alias("__a"), F.col(f"{s}_j").alias("__b")) for n, s in stars.items()]))).select("*", "__s.*")
    p = p.where(F.col("__a") != F.col("__b"))
    up = F.col("__a") > F.col("__b")
    gap = F.abs(F.col("__a") - F.col("__b"))
    pick = lambda c, hi: F.when(up if hi else ~up, F.col(f"{c}_i")).otherwise(F.col(f"{c}_j"))
    return p.select(
        gid, pick(key, True).alias("winner"), pick(key, False).alias("loser"), gap.alias("dstar"), confidence_weight(gap).alias("weight"),
        *[pick(c, True).alias(f"{c}_winner") for c in cols], *[pick(c, False).alias(f"{c}_loser") for c in cols], F.col("__source").alias(out))


def interval_pairs(labels: DataFrame, session: str, key: str, rating: str, split: str) -> DataFrame:
    """L3: repeated labels -> [min, max]; strictly separated intervals of one session and split; gap 1 half weight."""
    iv = labels.groupBy(session, split, key).agg(F.min(rating).alias("lo"), F.max(rating).alias("hi"))
    p = cross_class_pairs(iv, [session, split], key, "lo", ["hi"], low_cls="hi")
    d = F.col("lo_i") - F.col("hi_j")
    return p.select(session, split, F.col(f"{key}_i").alias("winner"), F.col(f"{key}_j").alias("loser"),
                    d.alias("dstar"), F.when(d == 1, 0.5).otherwise(1.0).alias("weight"))


def decision_errors(labels: DataFrame, gid: str, key: str) -> DataFrame:
    """L4: illegal label states: unknown word, tie group with a decision, ranked group with a tie, mixed status."""
    mixed = labels.groupBy(gid).agg(F.count_distinct("group_status").alias("__k"))
    d, s = F.col("decision"), F.col("group_status")
    why = (
        F.when(~d.isin("keep", "drop", "tie") | ~s.isin("ranked", "tie"), "unknown")
        .when((s == "tie") & (d != "tie"), "tie_group_with_decision").when((s == "ranked") & (d == "tie"), "ranked_group_with_tie")
        .when(F.col("__k") > 1, "mixed_status"))
    return labels.join(mixed, gid).withColumn("error", why).where(F.col("error").isNotNull()).select(gid, key, "error")


def keep_drop_pairs(labels: DataFrame, gid: str, key: str) -> DataFrame:
    """L4: inside ranked groups every kept item beats every dropped one."""
    ranked = labels.where((F.col("group_status") == "ranked") & F.col("decision").isin("keep", "drop"))
    p = cross_class_pairs(ranked.withColumn("__c", (F.col("decision") == "keep").cast("int")), gid, key, "__c", [])
    return p.select(gid, F.col(f"{key}_i").alias("winner"), F.col(f"{key}_j").alias("loser"))


def _directions(pairs: DataFrame) -> DataFrame:
    """Unordered pairs seen in both directions."""
    lo, hi = F.least("winner", "loser").alias("__lo"), F.greatest("winner", "loser").alias("__hi")
    return pairs.groupBy(lo, hi).agg(F.min("winner").alias("__a"), F.max("winner").alias("__z"), F.count(F.lit(1)).alias("rows")).where("__a <> __z")


def find_conflicts(pairs: DataFrame) -> DataFrame:
    """Unordered pairs for which both directions were seen."""
    return _directions(pairs).select(F.col("__lo").alias("left"), F.col("__hi").alias("right"), "rows")


def quarantine(pairs: DataFrame) -> DataFrame:
    """Drop every row of a contradictory pair."""
    bad = _directions(pairs).select("__lo", "__hi")
    keyed = pairs.withColumn("__lo", F.least("winner", "loser")).withColumn("__hi", F.greatest("winner", "loser"))
    return keyed.join(bad, ["__lo", "__hi"], "left_anti").drop("__lo", "__hi")


def dedupe_pairs(pairs: DataFrame, keys: list[str] = ("winner", "loser", "source")) -> DataFrame:
    """One row per (winner, loser, source) with the smallest weight."""
    return pairs.groupBy(*keys).agg(F.min("weight").alias("weight"))


def source_weights(pairs: DataFrame, domain: list[str], shares: dict[str, float] = SOURCE_SHARES) -> DataFrame:
    """Weight / domain mass * source share / number of domains of the source, normalised to 1."""
    mass = pairs.groupBy("source", *domain).agg(F.sum("weight").alias("__mass"))
    domains = mass.groupBy("source").agg(F.count(F.lit(1)).alias("__domains"))
    pair_list = [F.lit(x) for kv in sorted(shares.items()) for x in kv]
    share = F.try_element_at(F.create_map(*pair_list), F.col("source"))
    # every present source contributes exactly its share, so the normaliser is the sum over present sources
    norm = domains.agg(F.sum(share).alias("__norm"))
    j = pairs.join(mass, ["source", *domain]).join(F.broadcast(domains), "source").crossJoin(F.broadcast(norm))
    return j.withColumn("weight", F.col("weight") / F.col("__mass") * share / F.col("__domains") / F.col("__norm")).drop("__mass", "__domains", "__norm")


def duplicate_consistency(labels: DataFrame, key: str, rating: str) -> DataFrame:
    """Items labelled exactly twice: distribution of the difference and jumps of two or more levels."""
    d = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max(rating) - F.min(rating)).alias("diff")).where("n = 2")
    return d.groupBy("diff").agg(F.count(F.lit(1)).alias("items")).withColumn("is_jump", (F.col("diff") >= 2).cast("int"))


def copeland(rounds: DataFrame, gid: str, key: str, star: str, rnd: str) -> DataFrame:
    """Majority wins per item (a pair needs >= 2 votes for one side), with groups where a round is missing or undecided.

    One row per (group, item): ``wins``, ``status`` of the group (ok, missing_round, undecided_round, no_champion),
    ``is_champion`` and ``is_top2``.  All ratings of an item travel in one row, so a pair is one row too.  Groups are dealt to as
    many partitions as the session sets: small rows pack so well that adaptive execution would put too many of them in a task.
    """
    parts = int(rounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ratings = F.collect_list(F.struct(F.col(rnd).alias("rnd"), F.col(star).alias("star"))).alias("__ratings")
    dealt = lambda df: df.withColumn("__g", F.struct(gid)).repartition(parts, "__g")
    items = written(dealt(rounds.select(gid, key, rnd, star)).groupBy("__g", key).agg(ratings).select(f"__g.{gid}", key, "__ratings"))
    long = items.select(gid, F.explode("__ratings").alias("__x")).select(gid, "__x.*").where(F.col("rnd").isNotNull())
    n_rounds = long.agg(F.count_distinct("rnd").alias("__rounds"))
    per = dealt(long).groupBy("__g", "rnd", "star").agg(F.count("star").alias("k"))
    top = per.groupBy("__g", "rnd").agg(F.max(F.struct("star", "k")).alias("t"))
    state = top.where(F.col(f"__g.{gid}").isNotNull()).groupBy("__g").agg(F.count(F.lit(1)).alias("__have"), F.min(((F.col("t.star") > 0) & (F.col("t.k") == 1)).cast("int")).alias("__ok"))
    pairs = pairs_in_groups(items, gid, key, ["__ratings"], parts=parts)
    votes = lambda a, b: F.aggregate(F.col(a), F.lit(0), lambda n, x: n + F.size(F.filter(F.col(b), lambda y: x["rnd"].eqNullSafe(y["rnd"]) & (x["star"] > y["star"]))))
    tally = pairs.select(gid, f"{key}_i", f"{key}_j", votes("__ratings_i", "__ratings_j").alias("up"), votes("__ratings_j", "__ratings_i").alias("down"))
    won = F.when((F.col("up") > F.col("down")) & (F.col("up") >= 2), F.col(f"{key}_i")).when(
        (F.col("down") > F.col("up")) & (F.col("down") >= 2), F.col(f"{key}_j"))
    won = once(tally, key, won).where(F.col(key).isNotNull()).select(gid, key, F.lit(1).alias("__won"))
    members = dealt(items.select(gid, key, F.lit(0).alias("__won")).unionByName(won)).groupBy("__g", key).agg(F.sum("__won").alias("wins"))
    w = W.partitionBy("__g").orderBy(F.col("wins").desc(), key)
    ranked = members.withColumn("__r", F.row_number().over(w)).withColumn(
        "__second", F.max(F.when(F.col("__r") == 2, F.col("wins"))).over(W.partitionBy("__g"))).withColumn(
        "__best", F.max("wins").over(W.partitionBy("__g")))
    j = ranked.join(state, "__g").crossJoin(F.broadcast(n_rounds))
    status = F.when(F.col("__have") < F.col("__rounds"), "missing_round").when(F.col("__ok") == 0, "undecided_round").when(
        F.col("__second") == F.col("__best"), "no_champion").otherwise("ok")
    good = status == "ok"
    return j.select(
        F.col(f"__g.{gid}").alias(gid), key, "wins", status.alias("status"), (good & (F.col("__r") == 1)).cast("int").alias("is_champion"),
        (good & (F.col("wins") >= F.coalesce("__second", F.lit(0)))).cast("int").alias("is_top2"))


def retest_agreement(first: DataFrame, second: DataFrame, gid: str, key: str, star: str) -> DataFrame:
    """Groups decided in both rounds: champion agreement, and the second pick within the first round's top two."""
    a, b = group_verdict(first, gid, key, star), group_verdict(second, gid, key, star)
    w = W.partitionBy(gid).orderBy(F.col(star).desc(), key)
    runner = first.withColumn("__r", F.row_number().over(w)).where("__r = 2").select(gid, F.col(star).alias("__second"))
    j = a.select(gid, F.col("status").alias("s1"), F.col("winner").alias("w1")).join(
        b.select(gid, F.col("status").alias("s2"), F.col("winner").alias("w2")), gid)
    pick = first.select(gid, F.col(key).alias("w2"), F.col(star).alias("__pick"))
    j = j.join(runner, gid, "left").join(pick, [gid, "w2"], "left")
    both = (F.col("s1") == "win") & (F.col("s2") == "win")
    return j.agg(
        F.count_if(both).alias("decided"), F.count_if(~both).alias("skipped"), F.count_if(both & (F.col("w1") == F.col("w2"))).alias("agree"),
        F.count_if(both & (F.col("__pick") >= F.coalesce("__second", F.lit(0)))).alias("top_two"))


def anchor_constraints(anchors: DataFrame, batch, key: str, label: str, weight: str, unit_gap: float = 0.5) -> DataFrame:
    """Anchor pairs with different labels, weight w_i * w_j, scaled for a gap of one."""
    p = cross_class_pairs(anchors, batch, key, label, [weight])
    w = F.col(f"{weight}_i") * F.col(f"{weight}_j") * F.when(F.col(f"{label}_i") - F.col(f"{label}_j") == 1, unit_gap).otherwise(1.0)
    return p.select(F.col(f"{key}_i").alias("winner"), F.col(f"{key}_j").alias("loser"), w.alias("weight"), F.lit("anchor").alias("kind"))


def cap_constraints(items: DataFrame, event: str, seg, key: str, rating: str, order: str, big: int = 32, weight: float = 0.5) -> DataFrame:
    """Inside an event the top of a big segment capped at >= 4 beats the top of a big one capped at <= 3."""
    best = F.max(F.struct(rating, order, key)).alias("t")
    segs = items.groupBy(event, *[s for s in as_list(seg) if s != event]).agg(F.count(F.lit(1)).alias("n"), best).where(F.col("n") >= big)
    tops = segs.select(event, F.col(f"t.{key}").alias(key), (F.col(f"t.{rating}") >= 4).cast("int").alias("__hi"))
    p = cross_class_pairs(tops, event, key, "__hi", [])
    return p.select(F.col(f"{key}_i").alias("winner"), F.col(f"{key}_j").alias("loser"), F.lit(weight).alias("weight"), F.lit("cap").alias("kind"))


def flagged_constraints(items: DataFrame, event: str, key: str, rating: str, flag: str, per_item: int = 5, weight: float = 0.2, seed: str = "flag") -> DataFrame:
    """Every flagged item beats up to ``per_item`` low-rated unflagged items of its event, drawn by hash.

    Low-rated items get consecutive ranks in hash order; a flagged item takes one rank per stratum, so the draw is an
    equi-join on (event, rank) and no event is multiplied out.
    """
    from starfold.core import hash_position

    low = items.where((F.col(rating) <= 2) & (F.coalesce(F.col(flag), F.lit(0)) == 0)).select(event, key)
    ranked = hash_position(low, event, seed, key, "__rank").select(event, "__rank", F.col(key).alias("loser"))
    sizes = low.groupBy(event).agg(F.count(F.lit(1)).alias("__n"))
    a = items.where(F.col(flag) == 1).select(event, F.col(key).alias("winner")).join(sizes, event)
    a = a.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(per_item - 1)))).where(F.col("__m") < F.col("__n"))
    slots = F.least(F.lit(per_item).cast("long"), F.col("__n"))
    lo = F.floor(F.col("__m") * F.col("__n") / slots)
    width = F.floor((F.col("__m") + 1) * F.col("__n") / slots) - lo
    a = a.withColumn("__rank", (lo + hash_int(seed, "winner", "__m") % width + 1).cast("long"))
    return a.join(ranked, [event, "__rank"]).select("winner", "loser", F.lit(weight).alias("weight"), F.lit("flag").alias("kind"))


def choose_events(labels: DataFrame, event: str, gid: str, min_groups: int, count: int, seed: str) -> DataFrame:
    """Development events in hash order among those with enough groups."""
    ok = labels.groupBy(event).agg(F.count_distinct(gid).alias("groups")).where(F.col("groups") >= min_groups)
    return ok.withColumn("__h", hash_order(seed, F.col(event))).orderBy("__h").limit(count).drop("__h")


def assemble_preferences(sources: dict[str, DataFrame], development: DataFrame, exclude=("derived",)) -> DataFrame:
    """Union of ``(winner, loser, weight, event, group)`` sources with a source tag and a ``used`` flag.

    Excluded sources and pairs of development events stay visible as skipped rows, so they can be counted.
    """
    out = None
    for name, df in sources.items():
        part = df.select("winner", "loser", F.col("weight").cast("double").alias("weight"), "event", "group", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    dev = development.select("event").distinct().withColumn("__dev", F.lit(1))
    why = F.when(F.col("source").isin(list(exclude)), "excluded_source").when(F.col("__dev") == 1, "development_event")
    return out.join(dev, "event", "left").withColumn("skipped", why).drop("__dev")


def preference_errors(prefs: DataFrame, items: DataFrame, key: str, split: str, wanted: str = "train") -> DataFrame:
    """Boundary errors: self pair, bad weight, an end outside the wanted split or without an item."""
    side = lambda end: items.select(F.col(key).alias(end), F.col(split).alias(f"__{end}"))
    j = prefs.join(side("winner"), "winner", "left").join(side("loser"), "loser", "left")
    why = (
        F.when(F.col("winner") == F.col("loser"), "self_pair")
        .when(F.isnan("weight") | (F.col("weight") <= 0) | F.col("weight").isNull(), "bad_weight")
        .when(F.col("__winner").isNull() | F.col("__loser").isNull(), "unknown_item")
        .when((F.col("__winner") != wanted) | (F.col("__loser") != wanted), "outside_split"))
    return j.withColumn("error", why).where(F.col("error").isNotNull()).drop("__winner", "__loser")
