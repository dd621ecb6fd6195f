"""Similarity graph and clusters."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import as_list, checkpoint, quantiles, score_position, written
from starfold.functions.vectors import cosine, l2_normalize
from starfold.operators.joins import similar_in_group


CENTRAL_EPS = 1e-9
JUMPS = 5  # self-joins of a result before it is written as a table


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, component)`` with component = smallest id; isolated nodes keep themselves.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their roots and contracts the
    edges to roots, so the edge table shrinks quickly.  Rounds are cut by reliable checkpoints.
    Every vertex with an edge is joined to another in a round, so the live vertices halve at least.  The edges of a
    round, and every ``JUMPS``-th jump along a long chain, are written tables (see ``written``).
    """
    label = checkpoint(nodes.select("id", F.col("id").alias("component")))
    live = written(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        hook = both.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m"))
        root = checkpoint(hook.select("v", F.least("v", "m").alias("root")))
        jumps = 0
        while True:
            jumps += 1
            up = root.select(F.col("v").alias("root"), F.col("root").alias("__up"))
            jumped = root.join(up, "root", "left").select("v", F.coalesce("__up", "root").alias("__new"), (F.col("__up") != F.col("root")).alias("__moved"))
            jumped = written(jumped) if jumps % JUMPS == 0 else checkpoint(jumped)
            moved = not jumped.where("__moved").isEmpty()
            root = jumped.select("v", F.col("__new").alias("root"))
            if not moved:
                break
        a = root.select(F.col("v").alias("src"), F.col("root").alias("rs"))
        b = root.select(F.col("v").alias("dst"), F.col("root").alias("rd"))
        live = written(
            live.join(a, "src").join(b, "dst").where(F.col("rs") != F.col("rd"))
            .select(F.least("rs", "rd").alias("src"), F.greatest("rs", "rd").alias("dst")).distinct())
        label = checkpoint(label.join(root.select(F.col("v").alias("component"), "root"), "component", "left")
                           .select("id", F.coalesce("root", "component").alias("component")))
    return label


def cluster_profile(df: DataFrame, by, key: str, rating: str, vec: str) -> DataFrame:
    """Size, cap, is_top (all ties) and centrality = cosine to the normalised centroid (1 for singletons)."""
    by = as_list(by)
    unit = df.withColumn("__u", l2_normalize(F.col(vec)))
    stats = unit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cluster_size"), F.max(rating).alias("cluster_cap"),
        vector_to_array(Summarizer.mean(array_to_vector("__u"))).alias("__c"))
    j = unit.join(stats, by)
    return j.select(
        *df.columns, "cluster_size", "cluster_cap", (F.col(rating) == F.col("cluster_cap")).cast("int").alias("is_top"),
        F.when(F.col("cluster_size") > 1, cosine(F.col("__u"), F.col("__c"))).otherwise(1.0).alias("centrality"))


def cluster_sizes(df: DataFrame, cluster: str, seg: str, rating: str) -> DataFrame:
    """One row per cluster: segment, size, cap."""
    return df.groupBy(seg, cluster).agg(F.count(F.lit(1)).alias("n"), F.max(rating).alias("cap"))


def size_bucket(n: Column) -> Column:
    """Size class of a cluster."""
    return F.when(n == 1, "1").when(n <= 4, "2-4").when(n <= 15, "5-15").otherwise("16+")


def cluster_summary(df: DataFrame, cluster: str, seg: str, rating: str, centrality: str) -> DataFrame:
    """One row: size median / P90 / max, singletons (and those with >= 3 stars), clusters per segment, and the
    share of clusters of >= 2 whose tops are on average at least as central as the cluster median."""
    sizes = df.groupBy(seg, cluster).agg(F.count(F.lit(1)).alias("n"), F.max(rating).alias("cap"))
    med = quantiles(df, [seg, cluster], centrality, {"med": 0.5})
    tops = df.join(sizes.select(seg, cluster, "cap"), [seg, cluster]).where(F.col(rating) == F.col("cap"))
    top_mean = tops.groupBy(seg, cluster).agg(F.avg(centrality).alias("top_mean"))
    per_seg = sizes.groupBy(seg).agg(F.count(F.lit(1)).alias("k"))
    seg_stats = per_seg.agg(F.count(F.lit(1)).alias("segments"), F.max("k").alias("per_seg_max"))
    base = sizes.join(top_mean, [seg, cluster]).join(med, [seg, cluster]).agg(
        F.count(F.lit(1)).alias("clusters"), F.max("n").alias("size_max"),
        F.count_if(F.col("n") == 1).alias("singletons"), F.count_if((F.col("n") == 1) & (F.col("cap") >= 3)).alias("singletons_ge3"),
        F.avg(F.when(F.col("n") >= 2, (F.col("top_mean") >= F.col("med") - CENTRAL_EPS).cast("double"))).alias("central_share"))
    size_q = quantiles(sizes, [], "n", {"size_median": 0.5, "size_p90": 0.9})
    seg_q = quantiles(per_seg, [], "k", {"per_seg_median": 0.5, "per_seg_p90": 0.9})
    return base.crossJoin(seg_stats).crossJoin(size_q).crossJoin(seg_q)  # one-row frames


def size_cap_table(df: DataFrame, cluster: str, seg: str, rating: str) -> DataFrame:
    """Clusters by size class and cap."""
    sizes = cluster_sizes(df, cluster, seg, rating)
    table = sizes.groupBy(size_bucket(F.col("n")).alias("bucket")).pivot("cap", [0, 1, 2, 3, 4, 5]).agg(F.count(F.lit(1)))
    return table.fillna(0).withColumnsRenamed({str(k): f"cap_{k}" for k in range(6)})


def rating_pyramid(df: DataFrame, cluster: str, seg: str, rating: str, big: int = 16) -> DataFrame:
    """Mean count of each star inside big clusters."""
    counts = df.groupBy(seg, cluster).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(rating) == k).alias(f"s{k}") for k in range(6)]).where(F.col("n") >= big)
    return counts.agg(*[F.avg(f"s{k}").alias(f"mean_{k}") for k in range(6)], F.count(F.lit(1)).alias("clusters"))


def cluster_spans(df: DataFrame, by, key: str, vec: str, rating: str, thresholds: list[float]) -> DataFrame:
    """C4: per threshold: groups of >= 2, members, largest group and rating spans.

    Edges are found once at the lowest threshold and filtered for the others.
    """
    edges = checkpoint(similar_in_group(df, by, key, vec, min(thresholds)))
    nodes = df.select(F.col(key).alias("id"))
    out = None
    for t in thresholds:
        e = edges.where(F.col("cos") >= t).select(F.col(f"{key}_i").alias("src"), F.col(f"{key}_j").alias("dst"))
        comp = connected_components(e, nodes).withColumnRenamed("id", key)
        groups = df.join(comp, key).groupBy("component").agg(
            F.count(F.lit(1)).alias("n"), (F.max(rating) - F.min(rating)).alias("span")).where("n >= 2")
        row = groups.agg(
            F.lit(t).alias("threshold"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"),
            F.max("n").alias("largest"), F.avg("span").alias("span_mean"), F.max("span").alias("span_max"))
        out = row if out is None else out.unionByName(row)
    return out


def overlap_audit(members: DataFrame, clustered: DataFrame, key: str, cluster: list[str], big: int = 8) -> DataFrame:
    """Members of a set by cluster size class: tops, ordinary and big clusters touched."""
    j = members.select(key).distinct().join(clustered, key)
    touched = F.count_distinct(F.when(F.col("cluster_size") >= big, F.struct(*cluster)))
    return j.groupBy(size_bucket(F.col("cluster_size")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("is_top") == 1).alias("tops"),
        F.count_if(F.col("is_top") == 0).alias("ordinary"), touched.alias("big_clusters"))


def representatives(df: DataFrame, event: str, cluster: str, key: str, rep_score: str, rank_score: str, group_max: bool = False, tie: Column | None = None) -> DataFrame:
    """One row per cluster: its best member by ``rep_score`` and its ranking score (own, or the cluster's maximum)."""
    tie = F.col(key) if tie is None else tie
    best = F.min(F.struct((-F.col(rep_score)).alias("s"), tie.alias("t"), F.col(key), F.col(rank_score).alias("r")))
    g = df.groupBy(event, cluster).agg(best.alias("b"), F.max(rank_score).alias("m"), F.count(F.lit(1)).alias("cluster_n"))
    return g.select(event, cluster, F.col(f"b.{key}").alias(key), (F.col("m") if group_max else F.col("b.r")).alias("rank_score"), "cluster_n")


def one_per_cluster(df: DataFrame, event: str, cluster: str, key: str, rep_score: str, rank_score: str, fraction: float, group_max: bool = False) -> DataFrame:
    """One representative per cluster, then the top ``ceil(fraction * event size)`` of each event."""
    reps = representatives(df, event, cluster, key, rep_score, rank_score, group_max)
    budget = df.groupBy(event).agg(F.ceil(F.count(F.lit(1)) * fraction).alias("budget"))
    ranked = score_position(reps, [event], "rank_score", key, "pos")
    return ranked.join(budget, event).where(F.col("pos") <= F.col("budget"))


def neighbour_signal(edges: DataFrame, nodes: DataFrame, signal: str) -> DataFrame:
    """Mean signed advantage over similar neighbours (0 if none) and the degree; edges are ``(src, dst, signal)``."""
    both = edges.select(F.col("src").alias("id"), F.col(signal).alias("s")).unionByName(
        edges.select(F.col("dst").alias("id"), (-F.col(signal)).alias("s")))
    g = both.groupBy("id").agg(F.avg("s").alias("signal"), F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(g, "id", "left").fillna(0, ["signal", "degree"])


def pair_layers(cos: Column, hi: float, lo: float) -> Column:
    """Detail (>= hi), composition ([lo, hi)) or cross (< lo)."""
    return F.when(cos >= hi, "detail").when(cos >= lo, "composition").otherwise("cross")


__all__ = [
    "connected_components", "cluster_profile", "cluster_summary", "size_cap_table", "rating_pyramid", "cluster_spans",
    "overlap_audit", "representatives", "one_per_cluster", "neighbour_signal", "pair_layers",
]
