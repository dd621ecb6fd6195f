"""Vector columns: decoding, cosine, blocked similarity joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.core import as_list, bind, dot, hash_int, once, tie_blocks, written

SMALL_GROUP = 48
ROWS_PER_BLOCK = 2048
ROWS_PER_STRIP = 8192  # rows that travel together to a task
TILE = 1024  # rows of a block that are multiplied at once: a million cosines
QUANTILE_BINS = 1 << 14
CELL_SLACK = 1e-6


def decode_f32(length: int) -> Callable[[Column], Column]:
    """Little-endian float32 bytes to ``array<float>``; a wrong size gives NULL."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, dtype="<f4") if b is not None and len(b) == 4 * length else None)

    return decode


def encode_f32() -> Callable[[Column], Column]:
    """Inverse of ``decode_f32``: array to little-endian float32 bytes."""

    @F.pandas_udf(T.BinaryType())
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return encode


def as_double(v: Column) -> Column:
    """Array elements as doubles."""
    return v.cast("array<double>")


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return bind(F.sqrt(dot(v, v)), lambda norm: F.transform(as_double(v), lambda x: F.when(norm > 0, x / norm).otherwise(x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, NULL if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scale_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the population deviation of each column over the whole table, 0 replaced by 1."""
    return df.agg(*[
        F.coalesce(F.nullif(F.stddev_pop(F.nanvl(F.col(c), F.lit(None))), F.lit(0.0)), F.lit(1.0)).alias(f"__std_{c}") for c in cols
    ])


def scalar_distance(pairs: DataFrame, scales: DataFrame, cols: list[str], out: str = "cv_dist") -> DataFrame:
    """Euclidean distance over ``c_i - c_j`` in library deviations; missing parts skipped, all missing -> NULL."""
    parts = [F.pow((F.col(f"{c}_i") - F.col(f"{c}_j")) / F.col(f"__std_{c}"), 2) for c in cols]
    seen = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    joined = pairs.crossJoin(F.broadcast(scales))  # exactly one row on the right
    return joined.withColumn(out, F.when(seen > 0, F.sqrt(total))).drop(*[f"__std_{c}" for c in cols])


def _cells(width: float):
    """Angle cells of unit vectors against two fixed pivots.

    |angle(x,p) - angle(y,p)| <= angle(x,y), so vectors within ``width`` are in the same or an adjacent cell.
    """

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype("float64")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        dim = x.shape[1]
        pivots = np.stack([np.ones(dim), np.where(np.arange(dim) % 2 == 0, 1.0, -1.0)]) / math.sqrt(dim)
        angles = np.arccos(np.clip(x @ pivots.T, -1, 1))
        return pd.Series(list(np.floor(angles / width).astype("int32")))

    return cells


def _meetings(rows: DataFrame, by: list[str], threshold: float, rows_per_strip: int) -> DataFrame:
    """Every two strips of a group that can hold a match, once, as ``(by, __a, __b, ...)``; ``__a = __b`` is a strip with itself.

    ``rows`` (by, __id, __g, __v) are cut into angle cells (only the same and adjacent cells can hold a match, by the triangle
    inequality) and the cells into hash strips of about ``rows_per_strip`` rows.  A strip travels as one row, so what is
    shuffled is the rows times half the strips that they meet, and no task holds more than strips.
    """
    width = math.acos(max(-1.0, min(threshold, 1.0))) + CELL_SLACK
    rows = once(rows, "__c", _cells(width)(F.col("__v")))
    cells = rows.groupBy(*by, "__c").agg(F.ceil(F.count(F.lit(1)) / rows_per_strip).cast("int").alias("__k"))
    rows = rows.join(cells, [*by, "__c"]).withColumn("__s", (hash_int("block", "__id") % F.col("__k")).cast("int"))
    name = F.concat_ws(",", F.col("__c").cast("array<string>"), F.col("__s").cast("string"))
    packed = rows.groupBy(*by, "__c", "__s").agg(F.collect_list(F.struct("__id", "__g", "__v")).alias("__r"))
    strips = written(packed.select(*by, "__c", name.alias("__own"), F.col("__r.__id").alias("__id"), F.col("__r.__g").alias("__g"), F.flatten("__r.__v").alias("__v")))
    steps = F.array(*[F.array(F.lit(x), F.lit(y)) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    near_cells = F.transform(steps, lambda d: F.zip_with(F.col("__c"), d, lambda p, q: p + q))
    other = strips.select(*by, F.col("__c").alias("__oc"), F.col("__own").alias("__oth"))
    meet = strips.select(*by, "__own", F.explode(near_cells).alias("__oc")).join(other, [*by, "__oc"]).where(F.col("__own") <= F.col("__oth"))
    turn = F.pmod(F.xxhash64("__own", "__oth"), F.lit(2)) == 0  # each strip comes second in half of its meetings
    meet = meet.select(*by, F.when(turn, F.col("__own")).otherwise(F.col("__oth")).alias("__a"), F.when(turn, F.col("__oth")).otherwise(F.col("__own")).alias("__b"))
    for end in ("a", "b"):
        side = strips.select(*by, F.col("__own").alias(f"__{end}"), *[F.col(c).alias(f"{c}_{end}") for c in ("__id", "__g", "__v")])
        meet = meet.join(side.hint("shuffle_hash"), [*by, f"__{end}"])  # a join by strip deals the meetings over the tasks
    return meet


def _tiler(rows_per_block: int):
    """The function that multiplies the blocks of a task's meetings; it needs no module of this library in a worker."""
    step = min(rows_per_block, TILE)

    def unit(values: pa.Array, n: int) -> np.ndarray:
        """Rows of unit length from the flat values of a strip; a zero vector stays as it is."""
        x = values.to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(norm > 0, norm, 1.0)

    def tiles(batches: Iterator[pa.RecordBatch]):
        """``(meeting, rows, columns, cosines)`` of every two blocks of at most ``TILE`` rows; pairs of a strip with itself once, others NaN."""
        for batch in batches:
            for at in range(batch.num_rows):
                one = {c: batch.column(c)[at] for c in batch.schema.names}
                same = one["__a"] == one["__b"]
                a = unit(one["__v_a"].values, len(one["__id_a"]))
                b = a if same else unit(one["__v_b"].values, len(one["__id_b"]))
                for i in range(0, len(a), step):
                    for j in range(i if same else 0, len(b), step):
                        sim = a[i : i + step] @ b[j : j + step].T
                        if same and i == j:
                            sim[np.tril_indices(len(sim))] = np.nan
                        yield one, i, j, sim

    return tiles


def _group_rows(df: DataFrame, id_col: str, vec: str, by, group: str | None, small_group: int):
    """``(by, __id, __g, __v)`` of the rows with a vector, those in large groups, and the pairs of the small groups with their cosine."""
    carried = F.col(group) if group else F.lit(None).cast("int")
    rows = df.select(*by, F.col(id_col).alias("__id"), carried.alias("__g"), F.col(vec).alias("__v")).where(F.col("__v").isNotNull())
    if not by:
        return rows, None
    rows = rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), by)
    small = rows.where(F.col("__n") <= small_group).withColumn("__v", l2_normalize(F.col("__v")))
    a = small.select(*by, F.col("__id").alias("id_i"), F.col("__v").alias("__a"))
    b = small.select(*by, F.col("__id").alias("id_j"), F.col("__v").alias("__b"))
    near = a.join(b, by).where(F.col("id_i") < F.col("id_j")).select(*by, "id_i", "id_j", dot(F.col("__a"), F.col("__b")).alias("cos"))
    return rows.where(F.col("__n") > small_group).drop("__n"), near


def similarity_pairs(
    df: DataFrame, id_col: str, vec: str, threshold: float, by=None,
    rows_per_block: int = ROWS_PER_BLOCK, small_group: int = SMALL_GROUP, rows_per_strip: int = ROWS_PER_STRIP, differ: str | None = None,
) -> DataFrame:
    """All pairs of one group with cosine >= threshold, as ``(by, id_i < id_j, cos)``. Exact.

    Small groups compare rows in the JVM.  Large groups meet in strips; a task multiplies blocks of at most ``rows_per_block``
    rows of two strips and returns matches only, block by block.  A threshold of -1 takes all pairs of a group.  With ``differ``
    (without ``by``) only pairs whose values in that column differ are returned, with the values as ``group_i`` and ``group_j``.
    """
    by = as_list(by)
    rows, near = _group_rows(df, id_col, vec, by, differ, small_group)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + [f"id_i {id_type}", f"id_j {id_type}", "cos double"])
    if differ:
        kind = df.schema[differ].dataType.simpleString()
        schema += f", group_i {kind}, group_j {kind}"

    tiles = _tiler(rows_per_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, i, j, sim in tiles(batches):
            rows, cols = np.nonzero(sim >= threshold)
            x, y = pa.array(rows + i), pa.array(cols + j)
            if differ:
                keep = pc.fill_null(pc.not_equal(one["__g_a"].values.take(x), one["__g_b"].values.take(y)), False).to_numpy(zero_copy_only=False)
                rows, cols, x, y = rows[keep], cols[keep], x.filter(pa.array(keep)), y.filter(pa.array(keep))
            if not len(rows):
                continue
            p, q = one["__id_a"].values.take(x), one["__id_b"].values.take(y)
            up = pc.less(p, q)
            out = [pa.repeat(one[c], len(rows)) for c in by] + [pc.if_else(up, p, q), pc.if_else(up, q, p), pa.array(sim[rows, cols])]
            if differ:
                g, h = one["__g_a"].values.take(x), one["__g_b"].values.take(y)
                out += [pc.if_else(up, g, h), pc.if_else(up, h, g)]
            yield pa.RecordBatch.from_arrays(out, [*by, "id_i", "id_j", "cos", *(["group_i", "group_j"] if differ else [])])

    blocks = _meetings(rows, by, threshold, rows_per_strip).mapInArrow(run, schema)
    return near.where(F.col("cos") >= threshold).unionByName(blocks) if by else blocks


def similarity_counts(df: DataFrame, id_col: str, vec: str, edges: list[float], by=None, rows_per_block: int = ROWS_PER_BLOCK,
                      small_group: int = SMALL_GROUP, rows_per_strip: int = ROWS_PER_STRIP) -> DataFrame:
    """Pairs of one group by their cosine: ``(k, pairs)``, where ``k`` of the rising ``edges`` are at most the cosine.

    All pairs are compared; a task counts them and returns a row per ``k``, so no pair is shuffled.
    """
    by = as_list(by)
    rows, near = _group_rows(df, id_col, vec, by, None, small_group)
    cuts = np.asarray(edges, dtype="float64")

    tiles = _tiler(rows_per_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cuts) + 1, dtype="int64")
        for _, _, _, sim in tiles(batches):
            flat = sim[~np.isnan(sim)]
            total += np.bincount(np.searchsorted(cuts, flat, side="right"), minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "pairs"])

    found = _meetings(rows, by, -1.0, rows_per_strip).mapInArrow(run, "k bigint, pairs bigint")
    if by:
        steps = F.array(*[F.lit(float(c)) for c in edges])
        found = found.unionByName(near.groupBy(F.size(F.filter(steps, lambda c: c <= F.col("cos"))).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("pairs")))
    return found.groupBy("k").agg(F.sum("pairs").alias("pairs"))


def similarity_quantiles(df: DataFrame, id_col: str, vec: str, ps: dict[str, float], by=None, bins: int = QUANTILE_BINS, **kw) -> DataFrame:
    """Exact quantiles (linear interpolation) of the cosines of all pairs of a group, as one row.

    A first pass counts the pairs in even bins; a second returns only the cosines in the bins that hold a wanted rank.
    """
    edges = [-1.0 + 2.0 * k / bins for k in range(1, bins)]
    counts = {r["k"]: r["pairs"] for r in similarity_counts(df, id_col, vec, edges, by, **kw).collect()}  # a row per bin
    spark, n = df.sparkSession, sum(counts.values())
    if not n:
        return spark.createDataFrame([tuple(None for _ in ps)], ", ".join(f"{name} double" for name in ps))
    starts, before = {}, 0
    for k in sorted(counts):
        starts[k], before = before, before + counts[k]
    wanted = []
    for name, p in ps.items():
        at = p * (n - 1)
        for end, rank in (("lo", math.floor(at)), ("hi", math.ceil(at))):
            k = max(b for b, first in starts.items() if first <= rank)
            wanted.append((f"{name}_{end}", k, rank - starts[k]))
    ks = sorted({k for _, k, _ in wanted})
    spans = [(-math.inf if k == 0 else edges[k - 1], math.inf if k == bins - 1 else edges[k]) for k in ks]
    by = as_list(by)
    rows, near = _group_rows(df, id_col, vec, by, None, kw.get("small_group", SMALL_GROUP))

    tiles = _tiler(kw.get("rows_per_block", ROWS_PER_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, sim in tiles(batches):
            for k, (low, high) in zip(ks, spans, strict=True):
                values = sim[(sim >= low) & (sim < high)]
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, pa.int64()), len(values)), pa.array(values)], ["k", "cos"])

    inside = _meetings(rows, by, -1.0, kw.get("rows_per_strip", ROWS_PER_STRIP)).mapInArrow(run, "k bigint, cos double")
    if by:
        of = F.coalesce(*[F.when((F.col("cos") >= low) & (F.col("cos") < high), F.lit(k)) for k, (low, high) in zip(ks, spans, strict=True)])
        inside = inside.unionByName(near.select(of.cast("long").alias("k"), "cos").where("k is not null"))
    blocks = tie_blocks(inside, "k", "cos")
    below = F.col("n_total") - F.col("n_above") - F.col("n")
    at = {name: F.max(F.when((F.col("k") == k) & (below <= rank) & (rank < below + F.col("n")), F.col("cos"))) for name, k, rank in wanted}
    frac = {name: p * (n - 1) - math.floor(p * (n - 1)) for name, p in ps.items()}
    return blocks.agg(*[(at[f"{name}_lo"] + (at[f"{name}_hi"] - at[f"{name}_lo"]) * frac[name]).alias(name) for name in ps])


def cross_group_pairs(df: DataFrame, id_col: str, vec: str, group: str, threshold: float, **kw) -> DataFrame:
    """Similar pairs whose groups differ; one blocked join over the whole table, in which the groups travel along."""
    return similarity_pairs(df, id_col, vec, threshold, differ=group, **kw)


def compare_vectors(a: DataFrame, b: DataFrame, key: str, vec: str) -> DataFrame:
    """V9: one row: items compared, cosine min and mean, max and mean absolute difference, exact equality."""
    j = a.select(key, F.col(vec).alias("__a")).join(b.select(key, F.col(vec).alias("__b")), key)
    diff = F.transform(F.arrays_zip("__a", "__b"), lambda p: F.abs(p["__a"].cast("double") - p["__b"].cast("double")))
    j = j.select(
        cosine(F.col("__a"), F.col("__b")).alias("c"), F.array_max(diff).alias("mx"),
        F.aggregate(diff, F.lit(0.0), lambda s, x: s + x).alias("sm"), F.size("__a").alias("k"),
        F.equal_null(F.col("__a"), F.col("__b")).alias("eq"),
    )
    return j.agg(
        F.count(F.lit(1)).alias("items"), F.min("c").alias("cos_min"), F.avg("c").alias("cos_mean"),
        F.max("mx").alias("max_abs"), F.try_divide(F.sum("sm"), F.sum("k")).alias("mean_abs"),
        F.count_if(F.col("eq")).alias("equal_items"),
    )


def compare_grids(a: DataFrame, b: DataFrame, key: str, grid: str, plane: int) -> DataFrame:
    """V9: per scalar: cells, missing-mask differences, max and mean absolute difference over common cells."""
    j = a.select(key, F.col(grid).alias("__a")).join(b.select(key, F.col(grid).alias("__b")), key)
    cells = j.select(F.posexplode(F.arrays_zip("__a", "__b")).alias("p", "c")).select(
        F.floor(F.col("p") / plane).alias("scalar"),
        F.nanvl(F.col("c.__a").cast("double"), F.lit(None)).alias("x"), F.nanvl(F.col("c.__b").cast("double"), F.lit(None)).alias("y"),
    )
    return cells.groupBy("scalar").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("mask_diff"),
        F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs"),
    )


def score_batches(df: DataFrame, id_col: str, vec: str, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], dim: int,
                  lower_is_better: bool = False, batch_size: int = 1024) -> DataFrame:
    """Scores of a user model over a vector column, in Arrow batches; non-finite scores become NULL."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[dim]])
    first = df.select(F.col(id_col), as_double(F.col(vec)).alias("__v"))
    raw = once(first, "__s", predict(F.col("__v")))
    score = -F.col("__s") if lower_is_better else F.col("__s")
    return raw.select(id_col, F.when(~F.isnan("__s") & (F.abs("__s") < float("inf")), score).alias("score"))
