"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.core import checkpoint, ensure_checkpoint_dir

__all__ = ["SPACES", "WORD", "checkpoint", "ensure_checkpoint_dir", "join_small", "running", "vocabulary", "word_count"]

# The characters that separate words in every operator of this package.
SPACES = "\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side is broadcast; the count is always taken first.
BROADCAST_ROWS = 20_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def join_small(df: DataFrame, side: DataFrame, rows: int, on, how: str = "inner") -> DataFrame:
    """Join with a side of known row count: broadcast up to ``BROADCAST_ROWS``, else a shuffle join that adaptive execution can split."""
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, how)


def running(df: DataFrame, order: list, value: Column | None = None, out: str = "before") -> DataFrame:
    """Add the total of ``value`` (1 per row by default) over all rows before this one in the global ``order``.

    The rows are range-sorted once and written to the checkpoint folder; a row then knows its sorted partition and its
    place in it, and only one total per partition is windowed.  No row set meets in one task: ``order`` should end in
    a key that splits ties.  Nulls sort first, rows with equal keys get their places in an arbitrary order.
    """
    taken = {"__m", "__p", "__v", "__o"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are reserved")
    one = F.lit(1).cast("long") if value is None else value
    df = checkpoint(df.orderBy(*order).withColumns({"__m": F.monotonically_increasing_id(), "__v": one}))
    df = df.withColumn("__p", F.shiftright("__m", _LOCAL_BITS))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row per sorted partition
    offsets = df.groupBy("__p").agg(F.sum("__v").alias("__v")).select("__p", F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__o"))
    if value is None:
        here = F.col("__m").bitwiseAND((1 << _LOCAL_BITS) - 1)
    else:
        here = F.coalesce(F.sum("__v").over(W.partitionBy("__p").orderBy("__m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # as many rows as the sort has partitions, a bound set by spark.sql.shuffle.partitions
    return df.withColumn("__h", here).join(F.broadcast(offsets), "__p").withColumn(out, F.col("__o") + F.col("__h")).drop("__m", "__p", "__v", "__o", "__h")
