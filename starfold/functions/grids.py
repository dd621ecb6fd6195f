"""Grid and token columns as cell rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import correlation, dot, quantiles
from starfold.functions.scalars import angle_difference
from starfold.functions.vectors import l2_normalize

# Smoothing taps of the tilt histogram, exp(-0.5 * (k / 1.5)^2) for k = -3..3, normalised.
_RAW_TAPS = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-3, 4)]
TILT_TAPS = [t / sum(_RAW_TAPS) for t in _RAW_TAPS]
MIN_EDGE_POINTS = 300
MIN_COMMON_CELLS = 20


def null_nan(c: Column) -> Column:
    """NaN readings as NULL (done once, at load)."""
    return F.when(F.isnan(c), None).otherwise(c)


def cells(df: DataFrame, id_cols: list[str], grid: str, side: int) -> DataFrame:
    """Cell rows ``(id, scalar, row, col, v)`` of a scalar-major grid, missing readings NULL."""
    e = df.select(*id_cols, F.posexplode(grid).alias("p", "x"))
    plane = side * side
    return e.select(
        *id_cols, F.floor(F.col("p") / plane).cast("int").alias("scalar"),
        F.floor((F.col("p") % plane) / side).cast("int").alias("row"), (F.col("p") % side).cast("int").alias("col"),
        null_nan(F.col("x").cast("double")).alias("v"),
    )


def grid_stats(cell_rows: DataFrame, id_cols: list[str]) -> DataFrame:
    """E5: per scalar mean, population deviation, P10, minimum and an all-missing mask."""
    return cell_rows.groupBy(*id_cols, "scalar").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.1)).alias("p10"),
        F.min("v").alias("min"), (F.count("v") == 0).cast("int").alias("missing"),
    )


def grid_means(cell_rows: DataFrame, id_cols: list[str], scalars: dict[str, int]) -> DataFrame:
    """E5: whole-grid means of chosen scalars, one column each."""
    return cell_rows.groupBy(*id_cols).agg(
        *[F.avg(F.when(F.col("scalar") == k, F.col("v"))).alias(name) for name, k in scalars.items()]
    )


def pool_tokens(token_rows: DataFrame, id_cols: list[str]) -> DataFrame:
    """From ``(id, token, dim, v)``: normalised mean, deviation and mean||deviation vectors."""
    dims = token_rows.groupBy(*id_cols, "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    vec = dims.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("__d"))
    mean, dev = F.col("__d.m"), F.col("__d.s")
    return vec.select(
        *id_cols, l2_normalize(mean).alias("mean"), l2_normalize(dev).alias("std"),
        l2_normalize(F.concat(mean, dev)).alias("mean_std"),
    )


def pyramid_pool(token_rows: DataFrame, id_cols: list[str], side: int, levels=(2, 4)) -> DataFrame:
    """From ``(id, row, col, dim, v)``: block means per level, each block normalised, all concatenated."""
    lv = token_rows.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    size = F.lit(side) / F.col("level")
    lv = lv.withColumn("block", F.floor(F.col("row") / size) * F.col("level") + F.floor(F.col("col") / size))
    dims = lv.groupBy(*id_cols, "level", "block", "dim").agg(F.avg("v").alias("m"))
    blocks = dims.groupBy(*id_cols, "level", "block").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("d"))
    blocks = blocks.withColumn("u", l2_normalize(F.col("d.m")))
    return blocks.groupBy(*id_cols).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("level", "block", "u"))), lambda b: b["u"])).alias("pyramid")
    )


def _common(group_cells: DataFrame, gid: str, member: str) -> DataFrame:
    """Cells that every member of the group can read; groups with too few such cells vanish."""
    sizes = group_cells.groupBy(gid).agg(F.count_distinct(member).alias("__size"))
    valid = group_cells.groupBy(gid, "row", "col").agg(F.count("v").alias("__valid"))
    shared = valid.join(sizes, gid).where(F.col("__valid") == F.col("__size")).select(gid, "row", "col")
    enough = shared.groupBy(gid).agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= MIN_COMMON_CELLS)
    return group_cells.join(shared.join(enough, gid), [gid, "row", "col"])


def common_support_mean(group_cells: DataFrame, gid: str, member: str) -> DataFrame:
    """Mean over cells valid in every member, common cell count, and whether the member is the minimum."""
    means = _common(group_cells, gid, member).groupBy(gid, member).agg(F.avg("v").alias("support_mean"), F.first("common").alias("common"))
    best = means.groupBy(gid).agg(F.min(F.struct("support_mean", member))[member].alias("__pick"))
    return means.join(best, gid).withColumn("is_pick", (F.col(member) == F.col("__pick")).cast("int")).drop("__pick")


def cell_vote(group_cells: DataFrame, gid: str, member: str) -> DataFrame:
    """Per opponent the share of common cells with the smaller value, averaged; marks the best member.  A member alone has no opponents and no row.

    Counted per cell from the rank of the value among the group's members: wins over opponents in a cell are
    the members with a larger value, so no pair of cells is formed.
    """
    c = _common(group_cells, gid, member)
    w = W.partitionBy(gid, "row", "col").orderBy(F.col("v").desc())
    wins = c.withColumn("larger", F.rank().over(w) - 1)
    size = c.groupBy(gid).agg(F.count_distinct(member).alias("__size"))
    score = wins.groupBy(gid, member).agg(F.avg("larger").alias("__w")).join(size, gid)
    score = score.where(F.col("__size") > 1).select(gid, member, (F.col("__w") / (F.col("__size") - 1)).alias("vote"))
    best = score.groupBy(gid).agg(F.min(F.struct((-F.col("vote")).alias("v"), member))[member].alias("__pick"))
    return score.join(best, gid).withColumn("is_pick", (F.col(member) == F.col("__pick")).cast("int")).drop("__pick")


def saliency_moments(mass_cells: DataFrame, id_cols: list[str], side: int, band: int = 1) -> DataFrame:
    """From ``(id, row, col, v >= 0)``: centroid, spread, correlation, 3x3 and border shares, entropy, offsets."""
    total = mass_cells.groupBy(*id_cols).agg(F.sum("v").alias("__t"))
    m = mass_cells.join(total, id_cols).select(
        *id_cols, (F.col("v") / F.col("__t")).alias("m"), ((F.col("col") + 0.5) / side).alias("x"),
        ((F.col("row") + 0.5) / side).alias("y"), "row", "col",
    )
    third = F.least(F.floor(F.col("y") * 3), F.lit(2)) * 3 + F.least(F.floor(F.col("x") * 3), F.lit(2))
    share = lambda cond: F.sum(F.when(cond, F.col("m")).otherwise(0.0))
    g = m.groupBy(*id_cols).agg(
        F.sum(F.col("m") * F.col("x")).alias("cx"), F.sum(F.col("m") * F.col("y")).alias("cy"),
        F.sum(F.col("m") * F.col("x") * F.col("x")).alias("__xx"), F.sum(F.col("m") * F.col("y") * F.col("y")).alias("__yy"),
        F.sum(F.col("m") * F.col("x") * F.col("y")).alias("__xy"),
        *[share(third == k).alias(f"third_{k}") for k in range(9)],
        share(F.col("row") < band).alias("top"), share(F.col("row") >= side - band).alias("bottom"),
        share(F.col("col") < band).alias("left"), share(F.col("col") >= side - band).alias("right"),
        (-F.sum(F.when(F.col("m") > 0, F.col("m") * F.log("m")).otherwise(0.0)) / math.log(side * side)).alias("entropy"),
    )
    vx, vy = F.greatest(F.col("__xx") - F.col("cx") * F.col("cx"), F.lit(0.0)), F.greatest(F.col("__yy") - F.col("cy") * F.col("cy"), F.lit(0.0))
    to = lambda a, b: F.sqrt(F.pow(F.col("cx") - a, 2) + F.pow(F.col("cy") - b, 2))
    return (
        g.withColumn("sx", F.sqrt(vx)).withColumn("sy", F.sqrt(vy))
        .withColumn("corr", (F.col("__xy") - F.col("cx") * F.col("cy")) / F.greatest(F.col("sx") * F.col("sy"), F.lit(1e-6)))
        .withColumn("to_third", F.least(*[to(a / 3, b / 3) for a in (1, 2) for b in (1, 2)]))
        .withColumn("to_centre", to(0.5, 0.5)).withColumn("dx", F.abs(F.col("cx") - 0.5)).withColumn("dy", F.abs(F.col("cy") - 0.5))
        .drop("__xx", "__yy", "__xy")
    )


def boundary_stats(token_cells: DataFrame, id_cols: list[str], side: int, border: int = 1) -> DataFrame:
    """From ``(id, row, col, u = unit vector)``: coherence, strongest lines, border vs interior, mirror similarity."""
    base = token_cells.select(*id_cols, "row", "col", "u")
    links = []
    for kind, row, col in (
        ("h", F.col("row"), F.col("col") - 1), ("v", F.col("row") - 1, F.col("col")),
        ("mx", F.col("row"), side - 1 - F.col("col")), ("my", side - 1 - F.col("row"), F.col("col")),
    ):
        links.append(F.struct(F.lit(kind).alias("kind"), row.cast("int").alias("r"), col.cast("int").alias("c")))
    left = base.withColumn("__l", F.explode(F.array(*links))).select(
        *id_cols, F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.col("u").alias("ub"),
        F.col("__l.kind").alias("kind"), F.col("__l.r").alias("row"), F.col("__l.c").alias("col"),
    ).where("kind in ('h', 'v') or (kind = 'mx' and col < col_b) or (kind = 'my' and row < row_b)")
    sim = left.join(base, [*id_cols, "row", "col"]).select(
        *id_cols, "kind", "row", "col", "row_b", "col_b", dot(F.col("u"), F.col("ub")).alias("s"))
    base_stats = sim.groupBy(*id_cols).agg(*[F.avg(F.when(F.col("kind") == k, F.col("s"))).alias(f"__{k}") for k in ("h", "v", "mx", "my")])
    lines = sim.where("kind in ('h', 'v')").withColumn("line", F.when(F.col("kind") == "v", F.col("row")).otherwise(F.col("col")))
    lines = lines.groupBy(*id_cols, "kind", "line").agg(F.avg(1 - F.col("s")).alias("e"))
    tops = lines.groupBy(*id_cols).agg(*[
        x for k, name in (("v", "row"), ("h", "col")) for x in (
            F.max(F.when(F.col("kind") == k, F.struct("e", (-F.col("line")).alias("l")))).alias(f"__{name}"),
            F.avg(F.when(F.col("kind") == k, F.col("e"))).alias(f"__{name}_mean"))
    ])
    edge = sim.where("kind in ('h', 'v')").select(*id_cols, (1 - F.col("s")).alias("e"), F.explode(F.array(
        F.struct("row", "col"), F.struct(F.col("row_b").alias("row"), F.col("col_b").alias("col")))).alias("p"))
    cell = edge.groupBy(*id_cols, "p").agg(F.avg("e").alias("e"))
    is_border = (F.col("p.row") < border) | (F.col("p.row") >= side - border) | (F.col("p.col") < border) | (F.col("p.col") >= side - border)
    bands = cell.groupBy(*id_cols).agg(F.avg(F.when(is_border, F.col("e"))).alias("border"), F.avg(F.when(~is_border, F.col("e"))).alias("interior"))
    line = lambda n: (
        ((1 - F.col(f"__{n}.l")) / side).alias(f"{n}_line"), (F.col(f"__{n}.e") / F.greatest(F.col(f"__{n}_mean"), F.lit(1e-6))).alias(f"{n}_strength"))
    return base_stats.join(tops, id_cols).join(bands, id_cols).select(
        *id_cols, ((F.col("__h") + F.col("__v")) / 2).alias("coherence"), *line("row"), *line("col"), "border", "interior",
        F.col("__mx").alias("mirror_x"), F.col("__my").alias("mirror_y"),
    )


def descriptor_reliability(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of each descriptor between pair ends ``<name>_i`` and ``<name>_j``, plus the median."""
    one = pairs.agg(*[correlation(f"{n}_i", f"{n}_j").alias(n) for n in names])
    rows = one.unpivot([], names, "descriptor", "r")
    return rows.unionByName(rows.agg(F.percentile("r", F.lit(0.5)).alias("r")).select(F.lit("median").alias("descriptor"), "r"))


def tilt_peak(points: DataFrame, id_cols: list[str], angle: str, weight: str, bin_deg: float = 0.05) -> DataFrame:
    """``(id, tilt_deg, conf, n_edge)`` from weighted circular angle histograms; too few points give NULL."""
    half, bins = 45.0, int(round(90 / bin_deg))
    folded = F.pmod(F.col(angle) + half, F.lit(90.0))
    p = points.select(*id_cols, (F.floor(folded / bin_deg).cast("int") % bins).alias("bin"), F.col(weight).cast("double").alias("w"))
    hist = p.groupBy(*id_cols, "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c"))
    hist = hist.repartition(*id_cols)  # an id has at most ``bins`` rows; what follows is grouped and joined by id and shuffles nothing
    counts = hist.groupBy(*id_cols).agg(F.sum("c").alias("n_edge"), F.sum("w").alias("__total"))
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in zip(range(-3, 4), TILT_TAPS)])
    smooth = hist.withColumn("__k", F.explode(taps)).groupBy(
        *id_cols, F.pmod(F.col("bin") + F.col("__k.k"), F.lit(bins)).alias("bin")
    ).agg(F.sum(F.col("w") * F.col("__k.t")).alias("y"))
    peak = smooth.groupBy(*id_cols).agg(F.max(F.struct(F.round("y", 9).alias("y"), (-F.col("bin")).alias("b"))).alias("p")).select(
        *id_cols, (-F.col("p.b")).alias("__peak"))
    near = smooth.join(peak, id_cols).withColumn("d", F.pmod(F.col("bin") - F.col("__peak") + 1, F.lit(bins))).where("d <= 2")
    at = lambda k: F.coalesce(F.max(F.when(F.col("d") == k, F.col("y"))), F.lit(0.0))
    y = near.groupBy(*id_cols, "__peak").agg(at(0).alias("y0"), at(1).alias("y1"), at(2).alias("y2"))
    den = F.col("y0") - 2 * F.col("y1") + F.col("y2")
    sub = F.when(F.abs(den) > 1e-12, 0.5 * (F.col("y0") - F.col("y2")) / den).otherwise(0.0)
    ok = F.col("n_edge") >= MIN_EDGE_POINTS
    return y.join(counts, id_cols).select(
        *id_cols, F.when(ok, (F.col("__peak") + sub) * bin_deg - half).alias("tilt_deg"),
        F.when(ok, F.col("y1") / F.col("__total")).alias("conf"), "n_edge",
    )


def tilt_crosscheck(df: DataFrame, tilt: str, roll: str, conf: str, floors: list[float]) -> DataFrame:
    """Circular residual statistics of tilt against roll for each confidence floor."""
    d = df.withColumn("r", angle_difference(F.col(tilt), F.col(roll))).where(F.col("r").isNotNull())
    d = d.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))).where(F.col(conf) >= F.col("floor"))
    med = quantiles(d, "floor", "r", {"median": 0.5})
    d = d.join(F.broadcast(med), "floor")  # one row per literal floor
    d = d.withColumn("__dev", F.abs(F.col("r") - F.col("median"))).withColumn("__abs", F.abs("r"))
    stats = d.groupBy("floor").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.first("median").alias("median"), F.stddev_pop("r").alias("std"))
    return stats.join(quantiles(d, "floor", "__dev", {"mad": 0.5}), "floor").join(
        quantiles(d, "floor", "__abs", {"abs_p50": 0.5, "abs_p90": 0.9}), "floor")


def mask_components(mask_cells: DataFrame, id_cols: list[str], side: int) -> DataFrame:
    """4-neighbour blobs of mask cells: log(1+count), largest share and its bounding box."""
    from starfold.operators.clusters import connected_components

    item = F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols])
    nodes = mask_cells.select(*id_cols, "row", "col", F.concat_ws("#", item, F.lpad((F.col("row") * side + F.col("col")).cast("string"), 6, "0")).alias("id"))
    shifted = nodes.withColumn("__s", F.explode(F.array(
        F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")), F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c")))))
    edges = shifted.select(*id_cols, F.col("id").alias("src"), F.col("__s.r").alias("row"), F.col("__s.c").alias("col")).join(
        nodes.select(*id_cols, "row", "col", F.col("id").alias("dst")), [*id_cols, "row", "col"]).select("src", "dst")
    comp = connected_components(edges, nodes.select("id"))
    blobs = nodes.join(comp, "id").groupBy(*id_cols, "component").agg(
        F.count(F.lit(1)).alias("n"), (F.max("col") - F.min("col") + 1).alias("w"), (F.max("row") - F.min("row") + 1).alias("h"))
    first = F.min(F.struct((-F.col("n")).alias("n"), "component", "w", "h"))
    return blobs.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("blobs"), F.sum("n").alias("__t"), first.alias("b")).select(
        *id_cols, "blobs", (-F.col("b.n") / F.col("__t")).alias("largest_share"),
        (F.col("b.w") / side).alias("box_w"), (F.col("b.h") / side).alias("box_h"),
    )


def assemble_channels(items: DataFrame, cell_rows: DataFrame, id_col: str, scalars: list[str], n_scalars: int, side: int) -> DataFrame:
    """Per cell channel values with missing as 0, the missing share, and item scalars; no grid = zeros + full mask."""
    plane = cell_rows.groupBy(id_col, "row", "col").agg(
        *[F.coalesce(F.max(F.when(F.col("scalar") == k, F.col("v"))), F.lit(0.0)).alias(f"ch_{k}") for k in range(n_scalars)],
        F.avg(F.col("v").isNull().cast("double")).alias("missing"),
    )
    axis = items.sparkSession.range(side * side).select(F.floor(F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    full = items.select(id_col, *scalars).crossJoin(F.broadcast(axis))  # side*side rows, a constant
    return full.join(plane, [id_col, "row", "col"], "left").fillna(0.0, [f"ch_{k}" for k in range(n_scalars)]).fillna(1.0, ["missing"])
