"""Joins and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import as_list, hash_int, is_number, match, ranged
from starfold.functions.vectors import similarity_pairs

PAIR_BLOCK = 4096


def assemble_items(items: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """Inner equi-joins of several one-row-per-key tables."""
    for part in parts:
        items = items.join(part, key)
    return items


def attach_endpoints(pairs: DataFrame, items: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Add item columns of both pair ends, suffixed ``_i`` and ``_j``."""
    for end in ("i", "j"):
        side = items.select(F.col(key).alias(f"{key}_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in cols])
        pairs = pairs.join(side, f"{key}_{end}")
    return pairs


def orient(pairs: DataFrame, key: str, latent: str, rating: str, ptype: str = "ptype") -> DataFrame:
    """Winner and loser by the latent score for derived pairs, by the rating otherwise; undecided pairs vanish."""
    gap = F.when(F.col(ptype) == "derived", F.col(f"{latent}_i") - F.col(f"{latent}_j")).otherwise(
        (F.col(f"{rating}_i") - F.col(f"{rating}_j")).cast("double"))
    d = pairs.withColumn("__s", F.signum(gap)).where(F.col("__s") != 0)
    up = F.col("__s") > 0
    return d.withColumn("winner", F.when(up, F.col(f"{key}_i")).otherwise(F.col(f"{key}_j"))).withColumn(
        "loser", F.when(up, F.col(f"{key}_j")).otherwise(F.col(f"{key}_i"))).drop("__s")


def match_by_name(exports: DataFrame, items: DataFrame, event: str, name: str, key: str) -> DataFrame:
    """Per exported file: unique / several / none inside the event, and whether the name also lives elsewhere."""
    inside = items.groupBy(event, name).agg(F.count(F.lit(1)).alias("__hits"), F.min(key).alias("__key"))
    anywhere = items.groupBy(name).agg(F.count_distinct(event).alias("__events"))
    j = exports.join(inside, [event, name], "left").join(anywhere, [name], "left")
    hits = F.coalesce(F.col("__hits"), F.lit(0))
    return j.select(
        *exports.columns, F.when(hits == 0, "none").when(hits == 1, "unique").otherwise("several").alias("status"),
        F.when(hits == 1, F.col("__key")).alias("matched"),
        (F.coalesce(F.col("__events"), F.lit(0)) - (hits > 0).cast("int") > 0).alias("elsewhere"))


def flag_scope(items: DataFrame, matches: DataFrame, scope: DataFrame, key: str, event: str, flag: str) -> DataFrame:
    """Inside the listed events 1 for matches and 0 otherwise; other events keep their value."""
    m = matches.select(key).distinct().withColumn("__hit", F.lit(1))
    s = scope.select(event).distinct().withColumn("__in", F.lit(1))
    j = items.join(m, key, "left").join(s, event, "left")
    value = F.when(F.col("__in") == 1, F.coalesce(F.col("__hit"), F.lit(0))).otherwise(F.col(flag))
    return j.withColumn(flag, value).drop("__hit", "__in")


def flag_names(items: DataFrame, names: DataFrame | None, name: str, flag: str) -> DataFrame:
    """1/0 by a case-insensitive name list; NULL (unknown) when no list was given."""
    if names is None:
        return items.withColumn(flag, F.lit(None).cast("int"))
    listed = names.select(F.lower(name).alias("__n")).distinct().withColumn("__hit", F.lit(1))
    return items.join(listed, F.lower(F.col(name)) == F.col("__n"), "left").withColumn(flag, F.coalesce("__hit", F.lit(0))).drop("__n", "__hit")


def exclude_used(df: DataFrame, used: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Drop used ids, or with ``group`` every group that touches one."""
    if group is None:
        return df.join(used.select(key), key, "left_anti")
    return df.join(df.join(used.select(key), key, "left_semi").select(group).distinct(), group, "left_anti")


def keep_listed(df: DataFrame, listed: DataFrame, key) -> DataFrame:
    """Keep rows whose key is listed."""
    return df.join(listed.select(*as_list(key)), as_list(key), "left_semi")


def pairs_in_groups(df: DataFrame, by, key: str, cols: list[str], rows_per_block: int = PAIR_BLOCK, parts: int | None = None) -> DataFrame:
    """All pairs of a group, smaller key first: the pairs are the result.

    Rows are spread over hash blocks of about ``rows_per_block``; a row meets every block of its group, so a group of any
    size is many tasks.  With ``parts`` the rows go to that many partitions, which adaptive execution leaves as they are.
    """
    by = as_list(by)
    blocks = F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("__k")
    if parts is None:
        d = match(df, df.groupBy(*by).agg(blocks), by)
    else:
        dealt = df.withColumn("__key", F.struct(*by)).repartition(parts, "__key")
        d = dealt.join(dealt.groupBy("__key").agg(blocks), "__key")
    cell = F.struct(*by, "__blk").alias("__key")
    a = d.withColumn("__blk", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).select(cell, *by, F.col(key).alias(f"{key}_i"), *[F.col(c).alias(f"{c}_i") for c in cols])
    b = d.withColumn("__blk", (hash_int("pair", key) % F.col("__k")).cast("int")).select(cell, F.col(key).alias(f"{key}_j"), *[F.col(c).alias(f"{c}_j") for c in cols])
    if parts is not None:
        a, b = a.repartition(parts, "__key"), b.repartition(parts, "__key")
    return a.join(b, "__key").where(F.col(f"{key}_i") < F.col(f"{key}_j")).drop("__key")


def cross_class_pairs(df: DataFrame, by, key: str, cls: str, cols: list[str], min_gap: int = 1,
                      low_cls: str | None = None, rows_per_block: int = PAIR_BLOCK, max_gap: int | None = None) -> DataFrame:
    """Pairs of a group whose integer classes differ, higher class first (``_i``).

    With ``low_cls`` the condition is ``cls_i - low_cls_j >= min_gap`` (disjoint intervals).  ``max_gap`` bounds the difference
    before rows are joined.

    Joins on (group, lower class, block of higher rows, block of lower rows): every joined row is a result, and a cell has at
    most about ``rows_per_block`` squared of them, so a large group is never one task.  The number of partitions is the session's:
    adaptive execution sizes tasks by their input, and the pairs of a few megabytes of rows can be billions.
    """
    by, low_cls = as_list(by), low_cls or cls
    sizes = df.groupBy(*by, F.col(low_cls).alias("__low")).agg(F.count(F.lit(1)).alias("__n"))
    above = W.partitionBy(*by).orderBy(F.col("__low").desc()).rangeBetween(W.unboundedPreceding if max_gap is None else -max_gap, -min_gap)
    blocks = lambda n: F.greatest(F.ceil(n / rows_per_block), F.lit(1)).cast("int")
    sizes = sizes.select(*by, "__low", blocks(F.col("__n")).alias("__k"), blocks(F.coalesce(F.sum("__n").over(above), F.lit(0))).alias("__m"))
    cols = [c for c in dict.fromkeys([cls, low_cls, *cols]) if c != key]
    high = df.select(*by, F.col(key).alias(f"{key}_i"), *[F.col(c).alias(f"{c}_i") for c in cols])
    high = high.join(sizes, by).where(F.col("__low") <= F.col(f"{cls}_i") - min_gap)
    if max_gap is not None:
        high = high.where(F.col("__low") >= F.col(f"{cls}_i") - max_gap)
    high = high.withColumn("__blk", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    high = high.withColumn("__high", F.when(F.col("__m") > 1, hash_int("pair", f"{key}_i") % F.col("__m")).otherwise(0).cast("int")).drop("__k", "__m")
    low = df.withColumn("__low", F.col(low_cls)).join(sizes, [*by, "__low"]).withColumn("__high", F.explode(F.sequence(F.lit(0), F.col("__m") - 1))).select(
        *by, "__low", (hash_int("pair", key) % F.col("__k")).cast("int").alias("__blk"), "__high",
        F.col(key).alias(f"{key}_j"), *[F.col(c).alias(f"{c}_j") for c in cols])
    cell, parts = [*by, "__low", "__high", "__blk"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return high.repartition(parts, *cell).join(low.repartition(parts, *cell), cell).drop("__low", "__high", "__blk")


def similar_in_group(df: DataFrame, by, key: str, vec: str, threshold: float, cols: list[str] = ()) -> DataFrame:
    """Similarity join inside a group, with item columns of both ends."""
    pairs = similarity_pairs(df, key, vec, threshold, by=by).withColumnsRenamed({"id_i": f"{key}_i", "id_j": f"{key}_j"})
    return attach_endpoints(pairs, df, key, list(cols)) if cols else pairs


def count_below(df: DataFrame, by, value: str, query: str, key: str) -> DataFrame:
    """For every row the number of group rows with ``value`` strictly below its ``query`` value: ``(by, key, below)``; NULL for a NULL query."""
    by = as_list(by)
    data = df.select(*by, F.lit(None).cast(df.schema[key].dataType).alias(key), F.col(value).alias("__v"), F.lit(1).alias("__d"))
    ask = df.select(*by, key, F.col(query).alias("__v"), F.lit(0).alias("__d"))
    u = ranged(data.where(is_number("__v")).unionByName(ask), [*by, "__v", "__d", key])
    bins = u.groupBy(*by, "__p").agg(F.sum("__d").alias("__t"))
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*by, "__p", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__earlier"))
    w = W.partitionBy(*by, "__p").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    run = match(u, bins, [*by, "__p"]).withColumn("below", F.when(is_number("__v"), F.col("__earlier") + F.sum("__d").over(w)))
    return run.where("__d = 0").select(*by, key, "below")


def difference_partners(df: DataFrame, by, key: str, score: str, threshold: float) -> DataFrame:
    """Per row the number of group rows more than ``threshold`` lower and higher, without forming pairs."""
    by = as_list(by)
    low = count_below(df.withColumn("__q", F.col(score) - threshold), by, score, "__q", key).withColumnRenamed("below", "n_lower")
    neg = df.withColumn("__n", -F.col(score)).withColumn("__q", -F.col(score) - threshold)
    high = count_below(neg, by, "__n", "__q", key).withColumnRenamed("below", "n_higher")
    return match(low, high, [*by, key])


def band_of(value: Column, edges: list[float]) -> Column:
    """Index of the half-open band ``[edge_k, edge_k+1)``; NULL outside."""
    out = F.when(value.isNull() | (value < edges[0]), F.lit(None).cast("int"))
    for k, upper in enumerate(edges[1:]):
        out = out.when(value < upper, F.lit(k))
    return out


def with_parameters(df: DataFrame, **grids) -> DataFrame:
    """Every row under every combination of small literal parameter lists."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def pivot_versions(features: DataFrame, key: str, version: str, vec: str, versions: list[str]) -> DataFrame:
    """One row per item with a vector column per version; items lacking one or with unequal lengths get ``complete`` false."""
    wide = features.where(F.col(version).isin(versions)).groupBy(key).agg(
        *[F.first(F.when(F.col(version) == v, F.col(vec)), ignorenulls=True).alias(v) for v in versions])
    usual = features.where(F.col(version).isin(versions)).groupBy(version).agg(F.mode(F.size(vec)).alias("__len"))
    lens = usual.groupBy().agg(*[F.max(F.when(F.col(version) == v, F.col("__len"))).alias(f"__len_{v}") for v in versions])
    ok = F.lit(True)
    for v in versions:
        ok = ok & F.col(v).isNotNull() & F.coalesce(F.size(F.col(v)) == F.col(f"__len_{v}"), F.lit(False))
    return wide.crossJoin(F.broadcast(lens)).withColumn("complete", ok).drop(*[f"__len_{v}" for v in versions])


