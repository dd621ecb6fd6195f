"""Helpers shared by all operators: deterministic hashing, two-level ordering, tie blocks, checkpoints.

Ordering inside a group is always done in two levels.  A plain ``Window.partitionBy(group)`` sends a whole
group to one task, which fails when one group holds a third of the table.  Here rows are first put in
order-preserving buckets (partitions of a global sort, or hash prefixes), windows run inside ``(group, bucket)``
and only the small table of bucket totals is windowed per group.  The number of buckets follows
``spark.sql.shuffle.partitions``, which grows with the data.

Groups, times and scores may be NULL.  Rows are matched with their group's totals on a struct of the keys: a struct is
never NULL and its NULL fields are equal, so no row is lost and the join stays a plain equi-join.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HASH_BITS = 32
HASH_SPAN = 1 << 21  # above any hash bucket: shifts whole classes of rows before or behind others
BUCKETS_PER_PARTITION = 4
PLACE_BITS = 33  # monotonically_increasing_id keeps the place of a row in its partition in its low 33 bits
TIE_BLOCK = 100_000  # rows of equal score above which a block is numbered in hash buckets; the result does not depend on it


def as_list(cols) -> list[str]:
    """A column name or a list of them, as a list."""
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; a private folder only in local mode without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors and its lineage is cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the checkpoint folder, for loops that join their own results.

    A checkpoint keeps the estimated size of its plan, and a join's estimate is the product of its sides: after ``k`` joins of
    a result with itself the number has ``2 ** k`` times as many digits, and planning alone takes minutes.  A written table
    has the size of its files.  It stays until the session's folder goes, so it is packed well: texts take two thirds of the
    usual room.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_int(seed: str, *cols) -> Column:
    """32-bit integer from md5 of ``seed:col:col``; independent of partitioning and engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket_bits() -> int:
    """Binary digits of the number of buckets, from the session's shuffle partitions: 6 to 20."""
    spark = SparkSession.getActiveSession()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions")) if spark else 200
    return max(6, min(20, (BUCKETS_PER_PARTITION * partitions - 1).bit_length()))


def hash_bucket(hashed: Column) -> Column:
    """Order-preserving bucket of a 32-bit hash, below ``HASH_SPAN``."""
    return F.shiftright(hashed, HASH_BITS - bucket_bits())


def ranged(df: DataFrame, order: list) -> DataFrame:
    """The rows in sorted partitions: ``__p`` (the partition, in the global ``order``) and ``__i`` (the place in it, from 0).

    Spark samples the ranges itself, so the plan has no bounds in it, and adaptive execution sets the number of partitions.
    The sorted rows are checkpointed: what is counted per partition and what is joined to it must be one and the same sort.
    Groups come first in ``order`` and lie in consecutive partitions, so totals per (group, partition) are about as many rows
    as there are groups and partitions.  Rows without a value are sorted like others; end ``order`` in a key to split ties.
    """
    sorted_rows = checkpoint(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    at = F.col("__m")
    return sorted_rows.withColumns({"__p": F.shiftright(at, PLACE_BITS), "__i": at.bitwiseAND((1 << PLACE_BITS) - 1)}).drop("__m")


def match(df: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on columns of both sides where NULL equals NULL; the key columns are those of ``df``."""
    on = as_list(on)
    side = side.select(F.struct(*on).alias("__key"), *[c for c in side.columns if c not in on])
    return df.withColumn("__key", F.struct(*on)).join(side, "__key", how).drop("__key")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def prefix_totals(df: DataFrame, by, bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per (by, bucket): for each name the sum over all earlier buckets of the same group; the NULL bucket is first.

    The input is combined map-side; only bucket totals reach the per-group window.
    """
    by = as_list(by)
    totals = df.groupBy(*by, bucket).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    w = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *by, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0)).alias(n) for n in sums]
    )


def sorted_position(df: DataFrame, by, order: list, out: str = "pos") -> DataFrame:
    """1-based position in the group under ``order``, by one global sort of (group, order): NULL values come where Spark sorts them.

    A row's position is its place in its sorted partition, less the group's first place there, plus the group's rows in
    earlier partitions; only the totals per (group, partition) are windowed and joined.
    """
    by = as_list(by)
    d = ranged(df, [*by, *order])
    earlier = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = d.groupBy(*by, "__p").agg(F.min("__i").alias("__from"), F.count(F.lit(1)).alias("__n"))
    parts = parts.select(*by, "__p", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__from")).alias("__shift"))
    return match(d, parts, [*by, "__p"]).withColumn(out, F.col("__i") + F.col("__shift") + 1).drop("__p", "__i", "__shift")


def add_position(df: DataFrame, by, order: list, bucket: Column, out: str = "pos", where: Column | None = None) -> DataFrame:
    """1-based position in the group under ``order``; ``bucket`` must be monotone in that order, such as a hash prefix.

    ``where`` restricts the counting: rows outside it get NULL.  NULL buckets come first.
    """
    by = as_list(by)
    df = df.withColumn("__b", bucket)
    df = df.withColumn("__at_group", F.struct(*by, "__b"))
    one = F.lit(1) if where is None else F.when(where, 1).otherwise(0)
    before = prefix_totals(df, by, "__b", {"__before": one}).select(F.struct(*by, "__b").alias("__at_group"), "__before")
    w = W.partitionBy("__at_group").orderBy(*order)
    if where is None:
        pos = F.row_number().over(w)
    else:
        pos = F.when(where, F.sum(one).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        df.withColumn("__pos_in", pos).join(before, "__at_group")
        .withColumn(out, (F.col("__pos_in") + F.col("__before")).cast("long"))
        .drop("__b", "__at_group", "__before", "__pos_in")
    )


def hash_position(df: DataFrame, by, seed: str, key: str, out: str = "pos") -> DataFrame:
    """Position in a reproducible random order of each group."""
    df = df.withColumn("__h", hash_int(seed, key))
    return add_position(df, by, ["__h", key], hash_bucket(F.col("__h")), out).drop("__h")


def score_position(df: DataFrame, by, score: str, key: str, out: str = "pos", descending: bool = True, tie_block: int = TIE_BLOCK) -> DataFrame:
    """Position by score, ties in hash order of ``key``.  Rows with a NULL or NaN score are kept with a NULL position.

    The rows before a tie block come from ``tie_blocks``; inside a block rows are numbered by hash.  A block above
    ``tie_block`` rows (say, all scores equal) is numbered in hash buckets, so it is never one task.
    """
    by = as_list(by)
    blocks = tie_blocks(df.select(*by, score), by, score)
    before = F.col("n_above") if descending else F.col("n_total") - F.col("n_above") - F.col("n")
    blocks = blocks.select(*by, score, before.alias("__above"), (F.col("n") > tie_block).alias("__big"))
    d = df.withColumn("__h", hash_int("tie", key))
    bucket = hash_bucket(F.col("__h")).cast("long")
    large = match(d.select(*by, score, bucket.alias("__b")), blocks.where("__big").select(*by, score), [*by, score])
    inside = prefix_totals(large, [*by, score], "__b", {"__before": F.lit(1)})
    d = match(d, blocks, [*by, score], "left").withColumn("__b", F.when(F.coalesce("__big", F.lit(True)), bucket).otherwise(0))
    d = match(d, inside, [*by, score, "__b"], "left")
    rank = F.row_number().over(W.partitionBy(*by, score, "__b").orderBy("__h", key))
    pos = F.col("__above") + F.coalesce("__before", F.lit(0)) + rank
    return d.withColumn(out, pos.cast("long")).drop("__above", "__big", "__b", "__h", "__before")


def group_sizes(df: DataFrame, by, out: str = "n") -> DataFrame:
    """Row count per group."""
    return df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias(out))


def is_number(score: str | Column) -> Column:
    """Whether a score is neither NULL nor NaN."""
    c = F.col(score) if isinstance(score, str) else score
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def tie_blocks(df: DataFrame, by, score: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (group, distinct score), best score first; NULL and NaN scores are in no block.

    Columns: ``n`` rows in the block and each named sum; ``n_above`` and ``<name>_above`` totals over strictly
    better scores; ``n_total`` and ``<name>_total`` of the group's scored rows.
    """
    by = as_list(by)
    sums = sums or {}
    names = ["n", *sums]
    blocks = df.where(is_number(score)).groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    blocks = ranged(blocks, [*by, F.col(score).desc()]).withColumn("__g", F.struct(*by, "__p"))
    bins = blocks.groupBy(*by, "__p").agg(*[F.sum(n).alias(f"__s_{n}") for n in names])
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    bins = bins.select(
        F.struct(*by, "__p").alias("__g"),
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__p_{n}") for n in names],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in names],
    )
    w = W.partitionBy("__g").orderBy("__i").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"__w_{n}": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
    return blocks.join(bins, "__g").select(
        *by, score, *names,
        *[(F.col(f"__p_{n}") + F.col(f"__w_{n}")).alias(f"{n}_above") for n in names],
        *[f"{n}_total" for n in names],
    )


def rank_in_group(df: DataFrame, by, score: str, out: str) -> DataFrame:
    """Ascending average-tie rank of every row, 1 = lowest; NULL for a NULL or NaN score."""
    by = as_list(by)
    ranks = tie_blocks(df.select(*by, score), by, score).select(
        *by, score, (F.col("n_total") - F.col("n_above") - (F.col("n") - 1) / 2).alias(out)
    )
    return match(df, ranks, [*by, score], "left")


def quantiles(df: DataFrame, by, value: str, ps: dict[str, float | str], params: DataFrame | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) per group from ranks, so no group's values meet in one task.

    ``F.percentile`` keeps all distinct values of a group in one buffer; this picks the two order statistics
    of each quantile from the distributed tie blocks instead.  NULL values are ignored.  A probability may also
    be the name of a column of the one-row frame ``params``.
    """
    by = as_list(by)
    values = df.select(*by, F.col(value).cast("double").alias("__q")).where(F.col("__q").isNotNull())
    blocks = tie_blocks(values, by, "__q")
    if params is not None:
        blocks = blocks.crossJoin(F.broadcast(params))
    below = F.col("n_total") - F.col("n_above") - F.col("n")
    parts, out = [], []
    for name, p in ps.items():
        at = (F.col(p) if isinstance(p, str) else F.lit(p)) * (F.col("n_total") - 1)
        for end, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            parts.append(F.max(F.when((below <= rank) & (rank < below + F.col("n")), F.col("__q"))).alias(f"__{name}_{end}"))
        parts.append(F.max(at).alias(f"__{name}_at"))
        lo, hi, pos = F.col(f"__{name}_lo"), F.col(f"__{name}_hi"), F.col(f"__{name}_at")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return blocks.groupBy(*by).agg(*parts).select(*by, *out)


def complete(dims: list[DataFrame], df: DataFrame, on: list[str], zeros: list[str]) -> DataFrame:
    """Fill missing combinations of small dimension tables with zero counts."""
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(F.broadcast(d))
    return grid.join(df, on, "left").fillna(0, subset=zeros)


def values_frame(spark: SparkSession, name: str, values, kind: str) -> DataFrame:
    """A one-column literal frame (budgets, thresholds, bins)."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def r6(c) -> Column:
    """Round to six decimals without negative zero, for comparable outputs."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def correlation(a: str, b: str) -> Column:
    """Aggregate: Pearson correlation over the rows with both values, NULL if one of them does not vary (``F.corr`` divides by zero there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a costly column that later filters and projections must not recompute.

    The optimizer copies expressions into every filter that uses them; a generator is not copied.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside ``body`` (a lambda would evaluate it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
