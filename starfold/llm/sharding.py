"""Sharding by a Hilbert curve over several metadata dimensions.

Each dimension is quantised into ``2^bits`` ranges that hold about equal numbers of rows, so a skewed source or length still
uses the whole range.  Rows are sorted by their place on the curve, and the order is cut into runs of equal counts.  A
neighbourhood of the curve is a neighbourhood in every dimension, so the files' minima and maxima prune on each of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import checkpoint, running

BITS = 6
SHARDS = 24


def curve_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points, one row each: undo the excess rotations from the top bit down, then Gray-decode."""
    x = points.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for k in range(len(x)):
            high = (x[k] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(high, low, swap)
            if k:
                x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (np.int64(1) << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(len(x)):
            out = out << 1 | (x[k] >> level) & 1
    return out


def cuts(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` values that cut the column into ranges of about equal row counts; nulls lie below all."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    total = values.agg(F.sum("__c")).first()[0]
    if not total:
        return []
    placed = running(values, [column], F.col("__c"))
    part = F.floor(F.col("before") * parts / total)
    firsts = placed.select(column, part.alias("part")).groupBy("part").agg(F.min(column).alias("v"))  # one row per part
    return sorted(r["v"] for r in firsts.where("part > 0").collect())


def quantised(value: Column, bounds: list) -> Column:
    """Number of bounds at or below the value; 0 for null."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value)), F.lit(0))


def hilbert(df: DataFrame, columns: list[str], bits: int = BITS, out: str = "curve") -> DataFrame:
    """Add the curve index of a row over ``columns``, each quantised to ``2^bits`` ranges."""
    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_index(cells.to_numpy(), bits))

    cells = [quantised(F.col(c), cuts(df, c, 1 << bits)).cast("int").alias(f"q{k}") for k, c in enumerate(columns)]
    return df.withColumn(out, index(F.struct(*cells)))


def shard_by_curve(df: DataFrame, columns: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in a shard): equal runs of the curve order.

    Counts of any two shards differ by one at most.  Rows with equal curve index follow ``ties``; rows equal in all of
    them are interchangeable.  An empty frame stays empty; fewer rows than shards leave shards empty.
    """
    df = checkpoint(df)
    n = df.count()
    placed = running(hilbert(df, columns, bits), ["curve", *ties], out="__at")
    shard = F.expr(f"__at * {shards} div {max(1, n)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")  # the first place of a shard
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__at") - first).drop("__at")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards of documents over source, language and size: doc_id, size, text_crc32, curve, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text plus 8; a null text has none and its checksum is that of nothing.  The law is ``rows``: shards
    hold equal counts.  Equal texts of one source and language have one curve index and are neighbours.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_by_curve(slim, ["source", "lang", "size"], ["text_crc32", "doc_id"], shards)
    return out.select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents with one folder per shard, rows in curve order inside each file.

    A shard larger than one task's share is split over tasks by ranges of its slots, so every file covers a run of the curve.
    """
    keys = shard_documents(docs, shards).select(F.col("doc_id").alias("__d"), F.col("text_crc32").alias("__c"), F.col("size").alias("__n"), "shard", "slot")
    keys = keys.groupBy("__d", "__c", "__n").agg(F.min(F.struct("shard", "slot")).alias("__s"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumns({"__crc": F.crc32(text.cast("binary")), "__size": (F.octet_length(text) + 8).cast("long")})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__crc") == F.col("__c")) & (F.col("__size") == F.col("__n"))
    placed = d.join(keys, same).withColumns({"shard": F.col("__s.shard"), "__slot": F.col("__s.slot")})
    placed = placed.repartitionByRange("shard", "__slot").sortWithinPartitions("shard", "__slot")
    placed.select(*[c for c in docs.columns if c != "shard"], "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
