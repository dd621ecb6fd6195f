"""Time segments and order inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import as_list, is_number, match, quantiles, rank_in_group, ranged, score_position, sorted_position


def segment_by_gap(df: DataFrame, ts: str, gaps: dict[str, int], by=None, tie: str = "id") -> DataFrame:
    """0-based segment number per group; a new segment starts where the time step is strictly above the gap.

    ``ts`` is an integer time; ``gaps`` maps output columns to gap lengths, all found in one pass.  Works with and
    without ``by``: rows are sorted once over all groups, only summaries of sorted partitions meet in the per-group window.
    Rows without a time are kept with NULL segments and separate nothing.
    """
    by = as_list(by)
    d = ranged(df, [*by, ts, tie]).withColumn("__g", F.struct(*by, "__p"))
    w = W.partitionBy("__g").orderBy("__i")
    step = F.col(ts) - F.lag(ts).over(w)
    d = d.withColumns({f"__cut_{n}": F.coalesce((step > g).cast("int"), F.lit(0)) for n, g in gaps.items()})
    running = w.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({f"__run_{n}": F.sum(f"__cut_{n}").over(running) for n in gaps})
    slots = d.groupBy("__g", *by, "__p").agg(
        F.min(ts).alias("__first"), F.max(ts).alias("__last"), *[F.sum(f"__cut_{n}").alias(f"__cuts_{n}") for n in gaps]
    )
    order = W.partitionBy(*by).orderBy("__p")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    edge = F.col("__first") - F.lag("__last").over(order)
    slots = slots.withColumns({f"__edge_{n}": F.coalesce((edge > g).cast("int"), F.lit(0)) for n, g in gaps.items()})
    slots = slots.select("__g", *[
        (F.coalesce(F.sum(f"__cuts_{n}").over(before), F.lit(0)) + F.sum(f"__edge_{n}").over(upto)).alias(f"__off_{n}") for n in gaps
    ])
    out = d.join(slots, "__g")
    out = out.withColumns({n: F.when(F.col(ts).isNotNull(), F.col(f"__off_{n}") + F.col(f"__run_{n}")).cast("long") for n in gaps})
    return out.select(*df.columns, *gaps)


def segment_structure(df: DataFrame, ts: str, gaps: dict[str, int], by=None, tie: str = "id") -> DataFrame:
    """Per gap: segments, valid (>= 2 rows), singles, size and duration mean / median / max; rows without a time are in no segment."""
    by = as_list(by)
    seg = segment_by_gap(df.select(*by, ts, tie), ts, gaps, by, tie).where(F.col(ts).isNotNull())
    long = seg.unpivot([*by, ts, tie], list(gaps), "gap", "seg")
    sizes = long.groupBy("gap", *by, "seg").agg(F.count(F.lit(1)).alias("n"), (F.max(ts) - F.min(ts)).alias("d"))
    stats = sizes.groupBy("gap").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("n") >= 2).alias("valid"), F.count_if(F.col("n") == 1).alias("singles"),
        F.avg("n").alias("size_mean"), F.max("n").alias("size_max"), F.avg("d").alias("dur_mean"), F.max("d").alias("dur_max"))
    size_median = quantiles(sizes, "gap", "n", {"size_median": 0.5})
    return stats.join(size_median, "gap").join(quantiles(sizes, "gap", "d", {"dur_median": 0.5}), "gap")


def burst_groups(df: DataFrame, event: str, ts: str, seconds: float, tie: str = "id") -> DataFrame:
    """Chains of neighbours at most ``seconds`` apart inside an event."""
    return segment_by_gap(df, ts, {"burst": int(seconds * 1_000_000)}, [event], tie)


def position_in_group(df: DataFrame, by, order: str, rating: str, tie: str = "id") -> DataFrame:
    """T4: over groups of >= 3 with a unique non-zero winner: share of first, last and middle winners against 1/n."""
    by = as_list(by)
    pos = sorted_position(df, by, [order, tie], "__pos")
    tops = pos.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(rating, "__pos")).alias("w"),
                                F.max(F.struct(F.col(rating), (-F.col("__pos")).alias("p"))).alias("v"))
    unique = tops.where((F.col("n") >= 3) & (F.col(f"w.{rating}") > 0) & (F.col("w.__pos") == -F.col("v.p")))
    p = F.col("w.__pos")
    return unique.agg(
        F.count(F.lit(1)).alias("groups"), F.avg((p == 1).cast("double")).alias("first"), F.avg((p == F.col("n")).cast("double")).alias("last"),
        F.avg(((p > 1) & (p < F.col("n"))).cast("double")).alias("middle"), F.avg(1 / F.col("n")).alias("expected"),
    )


def lag_pairs(df: DataFrame, by, order: str, max_offset: int, payload: list[str], tie: str = "id") -> DataFrame:
    """T5: pairs within ``max_offset`` positions of each other: ``(by, <tie>_i, <tie>_j, offset, payload_i, payload_j)``.

    Positions are cut into chunks of ``2 * max_offset`` rows; a row meets its own chunk and, from the second half, the next
    one, so a long segment is spread over many tasks, candidates stay near three times the result, and rows of short groups
    travel once to each side.  Rows without a time come first, in the order of ``tie``.
    """
    by = as_list(by)
    pos = sorted_position(df.select(*by, order, *dict.fromkeys([tie, *payload])), by, [order, tie], "__pos")
    pos = pos.withColumn("__chunk", F.floor((F.col("__pos") - 1) / (2 * max_offset)))
    cols = list(dict.fromkeys([tie, *payload]))
    reaches = (F.col("__pos") - 1) % (2 * max_offset) >= max_offset  # the next chunk
    left = pos.select(*by, F.col("__pos").alias("__pi"), *[F.col(c).alias(f"{c}_i") for c in cols],
                      F.explode(F.when(reaches, F.array(F.col("__chunk"), F.col("__chunk") + 1)).otherwise(F.array("__chunk"))).alias("__chunk"))
    right = pos.select(*by, "__chunk", F.col("__pos").alias("__pj"), *[F.col(c).alias(f"{c}_j") for c in cols])
    gap = F.col("__pj") - F.col("__pi")
    return match(left, right, [*by, "__chunk"]).where((gap >= 1) & (gap <= max_offset)).select(
        *by, gap.alias("offset"), *[f"{c}_i" for c in cols], *[f"{c}_j" for c in cols])


def within_group_rank(df: DataFrame, by, value: str, out: str = "rank") -> DataFrame:
    """Average-tie rank scaled to (r - 0.5) / n."""
    by = as_list(by)
    ranked = rank_in_group(df, by, value, "__r")
    sizes = df.groupBy(*by).agg(F.count_if(is_number(value)).alias("__n"))
    return match(ranked, sizes, by).withColumn(out, (F.col("__r") - 0.5) / F.col("__n")).drop("__r", "__n")


def standardise(df: DataFrame, by, value: str, out: str = "z") -> DataFrame:
    """(v - mean) / population deviation, deviation 0 taken as 1; empty ``by`` = whole table."""
    by = as_list(by)
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    d = match(df, stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row without groups
    dev = F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))
    return d.withColumn(out, (F.col(value) - F.col("__m")) / dev).drop("__m", "__s")


def reorder_within(df: DataFrame, by, score: str, truth: str, key: str = "id", out: str = "ideal") -> DataFrame:
    """Hand the group's sorted scores to its members in truth order (upper bound of in-group ordering).

    Members without a truth, or beyond the number of scores, get NULL.
    """
    by = as_list(by)
    members = score_position(df.withColumn("__t", F.col(truth).cast("double")), by, "__t", key, "__rank").drop("__t")
    scores = score_position(df.select(*by, score, key), by, score, key, "__rank").select(*by, "__rank", F.col(score).alias(out))
    scores = scores.where("__rank is not null")
    return match(members, scores, [*by, "__rank"], "left").drop("__rank")


def first_non_null(df: DataFrame, by, order: list[Column | str], cols: list[str]) -> DataFrame:
    """Per column the first value in priority order; an aggregate, so no group is sorted in one task."""
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return df.groupBy(*as_list(by)).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in cols])
