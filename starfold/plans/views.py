"""Stand-in views over the driver tables: deterministic, the same in Spark and in SQL.

``items`` come from ``events``; ``shots`` add segments and clusters inside (event, owner); ``exam`` cuts shots into
groups of at most six.  Every view reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.core import hash_int, micros, sorted_position
from starfold.operators.segments import segment_by_gap

MINUTE = 60_000_000
SEG_GAP = 4320 * MINUTE
CLUSTER_GAP = 1440 * MINUTE
GROUP = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: id, event, owner, t (micros), star 0-5, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("event"), F.col("user_id").alias("owner"), micros("ts").alias("t"),
        F.least(F.floor(F.col("value") / 25), F.lit(5)).cast("int").alias("star"), "value")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their segment and cluster number inside (event, owner)."""
    return segment_by_gap(items(spark, sf_dir), "t", {"seg": SEG_GAP, "cluster": CLUSTER_GAP}, ["event", "owner"])


CLUSTER = ["event", "owner", "cluster"]
SEGMENT = ["event", "owner", "seg"]


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots with cluster size and the cluster-top flag (all ties)."""
    s = shots(spark, sf_dir)
    g = s.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("cluster_size"), F.max("star").alias("cluster_cap"))
    return s.join(g, CLUSTER).withColumn("is_top", (F.col("star") == F.col("cluster_cap")).cast("int"))


def with_scores(df: DataFrame) -> DataFrame:
    """Two scores: a coarse one with many ties and a finer one, both related to the stars."""
    return df.withColumn("score_a", (F.col("star") * 20 + hash_int("a", "id") % 100) / 200.0).withColumn(
        "score_b", (F.least(F.col("value"), F.lit(500.0)) / 5 + hash_int("b", "id") % 100) / 200.0)


def with_vectors(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Attach ``v`` by id modulo the number of embeddings."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1)).alias("__n"))  # one row
    keyed = df.crossJoin(F.broadcast(n)).withColumn("__vec", F.col("id") % F.col("__n")).drop("__n")
    return keyed.join(e.select(F.col("vec_id").alias("__vec"), F.col("embedding").alias("v")), "__vec").drop("__vec")


def with_scalars(df: DataFrame) -> DataFrame:
    """Three technical scalars with missing readings."""
    h = hash_int("cv", "id")
    reading = lambda shift: F.when(F.shiftright(h, shift) % 10 == 0, None).otherwise((F.shiftright(h, shift) % 1000) / 1000.0)
    return df.withColumn("sharp", reading(0)).withColumn("shake", reading(7)).withColumn("contrast", reading(14))


def with_split(df: DataFrame) -> DataFrame:
    """Event-level split by a fixed rule of the event name."""
    h = hash_int("split", "owner") % 10
    return df.withColumn("split", F.when(h < 6, "train").when(h < 8, "val").otherwise("test"))


def exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at most six consecutive shots of one (event, owner): gid, anon, id, user_star, old star."""
    s = sorted_position(items(spark, sf_dir), ["event", "owner"], ["t", "id"], "pos")
    g = s.withColumn("slot", ((F.col("pos") - 1) % GROUP).cast("int")).withColumn(
        "gid", F.concat_ws("/", "event", F.col("owner").cast("string"), F.floor((F.col("pos") - 1) / GROUP).cast("string")))
    n = g.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    return g.join(n, "gid").select(
        "gid", F.substring(F.lit("ABCDEF"), F.col("slot") + 1, F.lit(1)).alias("anon"), "id", "event", "owner", "t", "star", "value", "size",
        star_variant("u").alias("user_star"))


def star_variant(seed: str):
    """Star moved by -1, 0 or +1 by hash, kept in 0..5."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.col("star") + (hash_int(seed, "id") % 3).cast("int") - 1)).cast("int")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labelling rounds of the exam in long form."""
    e = exam(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rnd"), star_variant(f"round{k}").alias("user_star")) for k in range(3)]))
    return e.select("gid", "id", each.alias("r")).select("gid", "id", "r.*")
