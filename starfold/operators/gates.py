"""Validation gates (V1-V8): each returns the failing rows or a report; the caller decides whether to raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import as_list
from starfold.operators.joins import attach_endpoints


class GateError(ValueError):
    """A gate found failing rows."""


def require_empty(failing: DataFrame, what: str) -> None:
    """Raise with a few examples if a gate returned rows."""
    rows = failing.take(3)
    if rows:
        raise GateError(f"{what}: {[r.asDict() for r in rows]}")


def assert_unique(df: DataFrame, key) -> DataFrame:
    """V1: keys that occur more than once."""
    return df.groupBy(*as_list(key)).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def assert_scores(scores: DataFrame, items: DataFrame, key: str, score: str, probs: list[str] = (), tol: float = 1e-7) -> DataFrame:
    """V2: missing, duplicate or non-finite scores; probabilities outside [0, 1] or not summing to 1."""
    s = scores.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(score).alias("__s"), F.max(F.lit(1)).alias("__has"), *[F.first(p).alias(p) for p in probs])
    j = items.select(key).distinct().join(s, key, "left")
    finite = F.coalesce(~F.isnan("__s") & (F.abs("__s") < float("inf")), F.lit(False))
    why = F.when(F.col("__has").isNull(), "missing").when(F.col("__n") > 1, "duplicate").when(~finite, "not_finite")
    if probs:
        inside = F.lit(True)
        for p in probs:
            inside = inside & F.coalesce(F.col(p).between(0, 1), F.lit(False))
        total = sum((F.col(p) for p in probs[1:]), F.col(probs[0]))
        why = why.when(~inside, "probability_range").when(F.abs(total - 1) > tol, "probability_sum")
    return j.withColumn("error", why).where("error is not null").select(key, "error")


def join_one_to_one(key: DataFrame, labels: DataFrame, on, ident: str) -> DataFrame:
    """V3: rows that break a complete one-to-one join: missing on a side, repeated, or a different id."""
    on = as_list(on)
    a = key.groupBy(*on).agg(F.count(F.lit(1)).alias("__ka"), F.first(ident).alias("__ia"))
    b = labels.groupBy(*on).agg(F.count(F.lit(1)).alias("__kb"), F.first(ident).alias("__ib"))
    j = a.join(b, on, "full_outer")
    why = (
        F.when(F.col("__ka").isNull(), "unknown_label").when(F.col("__kb").isNull(), "missing_label")
        .when((F.col("__ka") > 1) | (F.col("__kb") > 1), "duplicate").when(~F.equal_null("__ia", "__ib"), "different_id"))
    return j.withColumn("error", why).where("error is not null").select(*on, "error")


def assert_split(items: DataFrame, split: DataFrame, event: str, pairs: DataFrame | None = None, key: str = "id") -> DataFrame:
    """V4: ``split`` is (event, split) rows: events in two splits, unassigned or unknown events, pairs across splits."""
    s = split.groupBy(event).agg(F.count(F.lit(1)).alias("__n"), F.min("split").alias("__s"))
    e = items.select(event).distinct().withColumn("__have", F.lit(1))
    j = e.join(s, event, "full_outer")
    why = F.when(F.col("__have").isNull(), "unknown_event").when(F.col("__n").isNull(), "unassigned_event").when(F.col("__n") > 1, "repeated_event")
    out = j.withColumn("error", why).where("error is not null").select(F.col(event).cast("string").alias("subject"), "error")
    if pairs is None:
        return out
    tagged = items.join(s.select(event, "__s"), event).select(key, "__s")
    p = attach_endpoints(pairs, tagged, key, ["__s"]).where(F.col("__s_i") != F.col("__s_j"))
    name = F.concat_ws("-", F.col(f"{key}_i").cast("string"), F.col(f"{key}_j").cast("string"))
    return out.unionByName(p.select(name.alias("subject"), F.lit("cross_split_pair").alias("error")))


def assert_groups(df: DataFrame, gid: str, size: tuple[int, int], distinct=(), single=(), used: DataFrame | None = None, key: str = "id") -> DataFrame:
    """V5: groups with a wrong size, repeated members where distinct is required, several values where one is required,
    or a previously used id."""
    counts = [F.count(F.lit(1)).alias("__n")] + [F.count_distinct(c).alias(f"__d_{c}") for c in {*distinct, *single}]
    d = df
    if used is not None:
        d = df.join(used.select(key).distinct().withColumn("__used", F.lit(1)), key, "left")
        counts.append(F.max("__used").alias("__u"))
    g = d.groupBy(gid).agg(*counts)
    errors = [F.when(~F.col("__n").between(*size), "size")]
    errors += [F.when(F.col(f"__d_{c}") != F.col("__n"), f"repeated_{c}") for c in distinct]
    errors += [F.when(F.col(f"__d_{c}") != 1, f"several_{c}") for c in single]
    if used is not None:
        errors.append(F.when(F.col("__u") == 1, "used_before"))
    return g.select(gid, F.explode(F.array_compact(F.array(*errors))).alias("error"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """V6: order-free fingerprint of a table: rows, xor and modular sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("hash_sum"))


def snapshot_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """V6: one fingerprint row per named table."""
    out = None
    for name, df in sorted(tables.items()):
        row = content_fingerprint(df).select(F.lit(name).alias("name"), "rows", "hash_xor", "hash_sum")
        out = row if out is None else out.unionByName(row)
    return out


def verify_snapshot(stored: DataFrame, current: DataFrame) -> DataFrame:
    """V6: per table ``same`` / ``changed`` / ``missing`` / ``new``."""
    a = stored.select("name", F.struct("rows", "hash_xor", "hash_sum").alias("__a"))
    b = current.select("name", "rows", F.struct("rows", "hash_xor", "hash_sum").alias("__b"))
    j = a.join(b, "name", "full_outer")
    status = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "new").when(F.col("__a") == F.col("__b"), "same").otherwise("changed")
    return j.select("name", "rows", status.alias("status"))


def column_coverage(df: DataFrame, columns: list[str], minimum: float = 0.95) -> DataFrame:
    """V7: per column filled rows, share and the pass flag, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot(["__n"], columns, "column", "filled")
    share = F.try_divide("filled", "__n")
    return long.select("column", "filled", F.col("__n").alias("rows"), share.alias("share"), (F.coalesce(share, F.lit(0.0)) >= minimum).alias("ok"))


def version_coverage(items: DataFrame, artefacts: DataFrame, key: str, version: str, wanted: list[str]) -> DataFrame:
    """V7: per wanted artefact version the items that have it against all items, and the gate."""
    total = items.agg(F.count_distinct(key).alias("expected"))
    have = artefacts.where(F.col(version).isin(wanted)).join(items.select(key).distinct(), key, "left_semi").groupBy(version).agg(F.count_distinct(key).alias("present"))
    names = total.withColumn(version, F.explode(F.array(*[F.lit(w) for w in wanted])))
    j = names.join(have, version, "left").fillna(0, ["present"])
    return j.select(version, "present", "expected", (F.col("present") == F.col("expected")).alias("ok"))


def pair_gate(pairs: DataFrame, items: DataFrame, key: str, split: str, seg: Column, cluster: Column, tie_cos: float = 0.98, tau: float = 1.0) -> DataFrame:
    """V8: counts of forbidden pairs: cross-split, cross-segment window pairs, tie residue, derived pairs with a non-top
    end or inside one cluster."""
    d = attach_endpoints(pairs, items.withColumn("__seg", seg).withColumn("__cl", cluster), key, [split, "__seg", "__cl", "is_top"])
    w, der = F.col("ptype") == "window", F.col("ptype") == "derived"
    tie = ~der & (F.col("cos") >= tie_cos) & F.coalesce(F.col("cv_dist") < tau, F.lit(False))
    one = d.agg(
        F.count_if(F.col(f"{split}_i") != F.col(f"{split}_j")).alias("cross_split"), F.count_if(w & (F.col("__seg_i") != F.col("__seg_j"))).alias("cross_segment"),
        F.count_if(tie).alias("tie_residue"), F.count_if(der & ((F.col("is_top_i") != 1) | (F.col("is_top_j") != 1))).alias("derived_dirty"),
        F.count_if(der & (F.col("__cl_i") == F.col("__cl_j"))).alias("derived_same_cluster"))
    return one.unpivot([], ["cross_split", "cross_segment", "tie_residue", "derived_dirty", "derived_same_cluster"], "check", "failures")


def pair_counts(pairs: DataFrame, items: DataFrame, key: str, split: str) -> DataFrame:
    """V8: pairs and weight mass by split and type."""
    d = attach_endpoints(pairs, items, key, [split])
    return d.groupBy(F.col(f"{split}_i").alias("split"), "ptype").agg(F.count(F.lit(1)).alias("pairs"), F.sum("weight").alias("weight"))


def orphans(pairs: DataFrame, items: DataFrame, key: str, rating: str) -> DataFrame:
    """V8: items without any pair, by rating."""
    used = pairs.select(F.explode(F.array(f"{key}_i", f"{key}_j")).alias(key)).distinct()
    return items.join(used, key, "left_anti").groupBy(rating).agg(F.count(F.lit(1)).alias("orphans"))
