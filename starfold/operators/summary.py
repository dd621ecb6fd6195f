"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import as_list, correlation, match, quantiles, rank_in_group, sorted_position
from starfold.functions.scalars import equivalent_focal, focal_bucket
from starfold.functions.vectors import scalar_distance, scale_frame
from starfold.operators.joins import attach_endpoints, band_of, similar_in_group

KNOTS = {"knot_p50": 0.5, "knot_p75": 0.75, "knot_p90": 0.9, "knot_p98": 0.98}


def file_extension(path: Column) -> Column:
    """Lower-case extension without the dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def decode_cost(path: Column) -> Column:
    """A1: cheapest decodable format first (fixed classes)."""
    ext = file_extension(path)
    return (
        F.when(ext.isin("heif", "heic", "hif"), 0).when(ext.isin("jpg", "jpeg"), 1)
        .when(ext.isin("png", "webp", "bmp", "gif", "tiff", "tif"), 2).otherwise(3))


def identity_groups(files: DataFrame, name: str, ts: str, subsec: str, path: str, keep: list[str]) -> DataFrame:
    """A1: group files by identity (base name, time, sub-second); representative by decode cost, then path.

    Kept columns come from the representative only; ``formats`` is the sorted distinct extension list.
    """
    fp = F.sha1(F.concat_ws("|", F.lower(F.col(name)), F.col(ts).cast("string"), F.coalesce(F.col(subsec).cast("string"), F.lit(""))))
    f = files.withColumn("fingerprint", fp)
    rep = F.min_by(F.struct(path, *keep), F.struct(decode_cost(F.col(path)), F.col(path)))
    return f.groupBy("fingerprint").agg(
        rep.alias("r"), F.array_join(F.array_sort(F.collect_set(file_extension(F.col(path)))), "|").alias("formats"),
        F.count(F.lit(1)).alias("files")
    ).select("fingerprint", F.col(f"r.{path}").alias(path), *[F.col(f"r.{c}").alias(c) for c in keep], "formats", "files")


def scan_report(items: DataFrame, fmt: str, focal: str, equiv: str, star: str, event: str, ts: str) -> DataFrame:
    """A2: long report rows (section, name, value) from one grouping-sets pass."""
    eq = equivalent_focal(F.col(focal), F.col(equiv))
    d = items.select(
        F.col(fmt).alias("f"), focal_bucket(eq).alias("b"), F.col(star).cast("string").alias("s"), F.col(event).alias("e"),
        F.when(eq >= 135, F.col(star).cast("string")).alias("t"), F.col(star).alias("n"))
    g = d.groupingSets([["f"], ["b"], ["s"], ["e", "s"], ["e"], ["t"]], "f", "b", "s", "e", "t").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("n") >= 3).alias("hi"))
    name = (
        F.when(F.col("g") == 15, F.concat(F.lit("format/"), F.col("f"))).when(F.col("g") == 23, F.concat(F.lit("focal/"), F.col("b")))
        .when(F.col("g") == 27, F.concat(F.lit("star/"), F.col("s"))).when(F.col("g") == 25, F.concat(F.lit("event_star/"), F.col("e"), F.lit("/"), F.col("s")))
        .when(F.col("g") == 29, F.concat(F.lit("event/"), F.col("e"))).otherwise(F.concat(F.lit("tele_star/"), F.col("t"))))
    rows = g.select(name.alias("name"), "c", F.when(F.col("g") == 29, F.col("hi") / F.col("c")).alias("share_ge3")).where(F.col("name").isNotNull())
    span = items.agg(F.lit("time_span").alias("name"), F.count(ts).alias("c"), ((F.max(ts) - F.min(ts)) / 3.6e9).alias("share_ge3"))
    return rows.unionByName(span).withColumnsRenamed({"c": "rows", "share_ge3": "value"})


def event_inventory(items: DataFrame, event: str, cluster, ts: str, annotated: str) -> DataFrame:
    """A3: per event: photos, clusters, singletons, time range, annotated items.

    Clusters are counted through one row per cluster, so no distinct set of a whole event is built in one task.
    """
    per = items.groupBy(event, *[c for c in as_list(cluster) if c != event]).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("z"), F.sum(annotated).alias("ann"))
    return per.groupBy(event).agg(
        F.sum("n").alias("photos"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.min("a").alias("first"), F.max("z").alias("last"), F.sum("ann").alias("annotated"))


def histogram_by(items: DataFrame, by, value: str) -> DataFrame:
    """A3: long histogram."""
    return items.groupBy(*as_list(by), value).agg(F.count(F.lit(1)).alias("n"))


def group_distribution(items: DataFrame, seg, rating: str, levels: int = 6, eps: float = 1e-6, large: int = 30) -> DataFrame:
    """A4: one row per star with overall share, mean and deviation of segment shares, plus KL statistics rows."""
    shares = items.groupBy(*as_list(seg)).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg((F.col(rating) == k).cast("double")).alias(f"p{k}") for k in range(levels)])
    overall = items.agg(*[F.avg((F.col(rating) == k).cast("double")).alias(f"q{k}") for k in range(levels)])
    j = shares.crossJoin(F.broadcast(overall))  # one row
    kl = sum((F.col(f"p{k}") * F.log((F.col(f"p{k}") + eps) / (F.col(f"q{k}") + eps)) for k in range(levels)), F.lit(0.0))
    j = j.withColumn("kl", kl).withColumn("kl_large", F.when(F.col("n") >= large, kl))
    agg = j.agg(
        *[x for k in range(levels) for x in (F.first(f"q{k}").alias(f"q{k}"), F.avg(f"p{k}").alias(f"m{k}"), F.stddev_pop(f"p{k}").alias(f"s{k}"))],
        F.avg("kl").alias("km"), F.max("kl").alias("kx"), F.avg("kl_large").alias("lm"), F.max("kl_large").alias("lx"))
    agg = agg.crossJoin(quantiles(j, [], "kl", {"kd": 0.5}))  # one-row frames
    agg = agg.crossJoin(quantiles(j.where("kl_large is not null"), [], "kl_large", {"ld": 0.5}))
    rows = [F.struct(F.lit(f"star_{k}").alias("name"), F.col(f"q{k}").alias("a"), F.col(f"m{k}").alias("b"), F.col(f"s{k}").alias("c")) for k in range(levels)]
    rows.append(F.struct(F.lit("kl_all").alias("name"), F.col("km").alias("a"), F.col("kd").alias("b"), F.col("kx").alias("c")))
    rows.append(F.struct(F.lit("kl_large").alias("name"), F.col("lm").alias("a"), F.col("ld").alias("b"), F.col("lx").alias("c")))
    return agg.select(F.inline(F.array(*rows)))


def share_above(items: DataFrame, seg, rating: str, k: int, small: int = 30) -> DataFrame:
    """A5: share with rating >= k overall and over segments; zero-share segments, and those of them that are small."""
    per = items.groupBy(*as_list(seg)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(rating) >= k).alias("h"))
    share = F.col("h") / F.col("n")
    return per.agg(
        (F.sum("h") / F.sum("n")).alias("overall"), F.avg(share).alias("mean"), F.stddev_pop(share).alias("std"), F.min(share).alias("min"),
        F.max(share).alias("max"), F.count_if(F.col("h") == 0).alias("zero"), F.count_if((F.col("h") == 0) & (F.col("n") < small)).alias("zero_small"))


def flag_coverage(items: DataFrame, by, flag: str) -> DataFrame:
    """Tri-state flag per group: rows, flagged, unknown and the rate among known rows."""
    return items.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(flag) == 1).alias("flagged"), F.count_if(F.col(flag).isNull()).alias("unknown"),
        F.try_divide(F.count_if(F.col(flag) == 1), F.count(flag)).alias("rate"))


def quantile_summary(df: DataFrame, by, value: str, ps: dict[str, float], cuts: list[float]) -> DataFrame:
    """Exact quantiles and shares at or above each cut."""
    by = as_list(by)
    g = df.groupBy(*by).agg(F.count(value).alias("n"), *[F.avg((F.col(value) >= c).cast("double")).alias(f"ge_{c}") for c in cuts])
    q = quantiles(df, by, value, ps)
    return g.join(q, by, "left") if by else g.crossJoin(q)  # two one-row frames


def separation(within: DataFrame, cross: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """Per cut the within and cross shares and their ratio.  ``within`` has the counts ``(k, pairs)`` of the cosines at or above ``k`` of the rising cuts."""
    cuts = [float(c) for c in cuts]
    total = within.agg(F.sum("pairs").alias("n"), *[F.sum(F.when(F.col("k") > i, F.col("pairs")).otherwise(0)).alias(f"n{i}") for i in range(len(cuts))])
    far = cross.agg(*[F.avg((F.col(value) >= c).cast("double")).alias(f"c{i}") for i, c in enumerate(cuts)])
    rows = F.array(*[F.struct(F.lit(c).alias("cut"), F.try_divide(F.col(f"n{i}"), F.col("n")).alias("within"), F.col(f"c{i}").alias("cross")) for i, c in enumerate(cuts)])
    return total.crossJoin(far).select(F.inline(rows)).withColumn("ratio", F.try_divide("within", "cross"))  # two one-row frames


def window_recall(items: DataFrame, pairs: DataFrame, seg, order: str, key: str, widths: list[int]) -> DataFrame:
    """Per window width the share of the similar pairs it reaches and the number of pairs it would form."""
    seg = as_list(seg)
    pos = sorted_position(items.select(*seg, order, key), seg, [order, key], "pos")
    far = attach_endpoints(pairs, pos, key, ["pos"]).select(F.abs(F.col("pos_i") - F.col("pos_j")).alias("d"))
    reach = far.agg(F.count(F.lit(1)).alias("similar"), *[F.count_if(F.col("d") <= w).alias(f"r{w}") for w in widths])
    sizes = items.groupBy(*seg).agg(F.count(F.lit(1)).alias("n"))
    formed = sizes.agg(*[F.sum(F.expr(f"least(n - 1, {w}L) * n - least(n - 1, {w}L) * (least(n - 1, {w}L) + 1) / 2")).cast("long").alias(f"f{w}") for w in widths])
    rows = F.array(*[F.struct(F.lit(w).alias("width"), F.try_divide(F.col(f"r{w}"), F.col("similar")).alias("recall"), F.col(f"f{w}").alias("pairs")) for w in widths])
    return reach.crossJoin(formed).select(F.inline(rows))  # two one-row frames


def calibrate_thresholds(knots: DataFrame, cross: DataFrame, close: DataFrame, cos: str, dist: str) -> DataFrame:
    """tau_hi, tau_lo, tau_cv at P40 / P60 and weight knots, the window quantiles ``KNOTS`` as a frame of one row, as one row."""
    c = quantiles(cross, [], cos, {"p999": 0.999})
    n = quantiles(close, [], dist, {"tau_cv_p40": 0.4, "tau_cv_p60": 0.6})
    tau_lo = F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.ceil(F.col("p999") * 100) / 100))
    return knots.crossJoin(c).crossJoin(n).select(  # three one-row frames
        F.lit(0.98).alias("tau_hi"), tau_lo.alias("tau_lo"), "tau_cv_p40", "tau_cv_p60", *KNOTS)


def conditional_retain(pairs: DataFrame, layer: str, dist: str, q: float) -> DataFrame:
    """A10: keep pairs strictly above the layer's distance quantile; unknown distances drop out."""
    known = pairs.where(F.col(dist).isNotNull())
    cut = quantiles(known, layer, dist, {"__cut": q})
    return known.join(cut, layer).where(F.col(dist) > F.col("__cut")).drop("__cut")


def variance_shares(items: DataFrame, event: str, seg: str, value: str) -> DataFrame:
    """Shares of the sum of squares between events, between segments of an event, and within segments."""
    v = F.col(value).cast("double")
    s = items.groupBy(event, seg).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(F.lit(1))).alias("ss"))
    e = s.groupBy(event).agg(F.sum("n").alias("en"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("em"))
    t = e.agg((F.sum(F.col("en") * F.col("em")) / F.sum("en")).alias("g"))
    between = e.crossJoin(F.broadcast(t)).agg(F.sum(F.col("en") * F.pow(F.col("em") - F.col("g"), 2)).alias("ss_event"), F.count(F.lit(1)).alias("events"))
    inner = s.join(e, event).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("em"), 2)).alias("ss_seg"), F.sum("ss").alias("ss_within"), F.count(F.lit(1)).alias("segments"))
    total = F.col("ss_event") + F.col("ss_seg") + F.col("ss_within")
    return between.crossJoin(inner).select(  # two one-row frames
        F.try_divide("ss_event", total).alias("event_share"), F.try_divide("ss_seg", total).alias("seg_share"),
        F.try_divide("ss_within", total).alias("within_share"), "events", "segments")


def between_share(items: DataFrame, group, value: str) -> DataFrame:
    """Variance of group means over total variance of a value."""
    v = F.col(value).cast("double")
    g = items.groupBy(*as_list(group)).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(F.lit(1))).alias("ss"))
    t = g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    b = g.crossJoin(F.broadcast(t)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("b"), F.sum("ss").alias("w"))
    return b.select(F.try_divide("b", F.col("b") + F.col("w")).alias("between_share"))


def mean_table(items: DataFrame, by, value: str, weight: str | None = None) -> DataFrame:
    """Size and (weighted) mean per group."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return items.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("mean"))


def co_promotion(items: DataFrame, seg, key: str, vec: str, rating: str, edges: list[float], ks=(1, 3)) -> DataFrame:
    """Per cosine band and threshold k: pairs with at least one >= k and the share with both."""
    p = similar_in_group(items, seg, key, vec, edges[0], [rating]).withColumn("band", band_of(F.col("cos"), edges)).where(F.col("band").isNotNull())
    p = p.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.greatest(f"{rating}_i", f"{rating}_j") >= F.col("k"))
    both = (F.least(f"{rating}_i", f"{rating}_j") >= F.col("k")).cast("double")
    return p.groupBy("k", "band").agg(F.count(F.lit(1)).alias("pairs"), F.avg(both).alias("p_both"))


def positive_sibling(items: DataFrame, seg, key: str, vec: str, rating: str, cuts: list[float], k: int = 1) -> DataFrame:
    """Share of zero-rated items whose most similar neighbour rated >= k reaches each cosine cut."""
    p = similar_in_group(items, seg, key, vec, min(cuts), [rating])
    ends = p.select(F.col(f"{key}_i").alias(key), F.col(f"{rating}_i").alias("r"), F.col(f"{rating}_j").alias("o"), "cos").unionByName(
        p.select(F.col(f"{key}_j").alias(key), F.col(f"{rating}_j").alias("r"), F.col(f"{rating}_i").alias("o"), "cos"))
    best = ends.where((F.col("r") == 0) & (F.col("o") >= k)).groupBy(key).agg(F.max("cos").alias("best"))
    zero = items.where(F.col(rating) == 0).agg(F.count(F.lit(1)).alias("zero"))
    hit = best.agg(*[F.count_if(F.col("best") >= c).alias(f"h{i}") for i, c in enumerate(cuts)])
    return hit.crossJoin(zero).select(F.inline(F.array(*[  # two one-row frames
        F.struct(F.lit(float(c)).alias("cut"), "zero", F.try_divide(F.col(f"h{i}"), F.col("zero")).alias("share")) for i, c in enumerate(cuts)])))


def cross_tab(df: DataFrame, row: str, col: str, levels: list[int]) -> DataFrame:
    """Counts of one label against another."""
    t = df.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1))).fillna(0)
    return t.withColumnsRenamed({str(k): f"c{k}" for k in levels})


def spearman(df: DataFrame, by, a: str, b: str) -> DataFrame:
    """Rank correlation with average ties."""
    by = as_list(by)
    r = rank_in_group(rank_in_group(df.select(*by, a, b), by, a, "__ra"), by, b, "__rb")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("__ra", "__rb").alias("spearman"))


def exposure_ledger(draws: DataFrame, batch: str) -> DataFrame:
    """Draws, unique pairs and items, and batches touched, per source."""
    pair = F.struct(F.least("winner", "loser"), F.greatest("winner", "loser"))
    main = draws.groupBy("source").agg(
        F.count(F.lit(1)).alias("draws"), F.count_distinct(pair).alias("unique_pairs"), F.count_distinct(batch).alias("batches"),
        F.count_distinct("event").alias("events"))
    items = draws.select("source", F.explode(F.array("winner", "loser")).alias("i")).groupBy("source").agg(F.count_distinct("i").alias("unique_items"))
    return main.join(items, "source")


def near_duplicate_distance(items: DataFrame, seg, key: str, vec: str, scalars: list[str], threshold: float) -> DataFrame:
    """Technical distance of pairs with cosine >= threshold: counts, deciles and P40 / P60."""
    p = similar_in_group(items, seg, key, vec, threshold, scalars)
    p = scalar_distance(p, scale_frame(items, scalars), scalars)
    n = p.agg(F.count(F.lit(1)).alias("pairs"), F.count("cv_dist").alias("valid"))
    ps = (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9)
    return n.crossJoin(quantiles(p, [], "cv_dist", {f"p{round(x * 100)}": x for x in ps}))  # two one-row frames
