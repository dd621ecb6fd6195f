"""Queries of incremental ingest (S): the stream input is the events table cut into files by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from starfold.plans import views
from starfold.plans.registry import query
from starfold.plans.store import scratch
from starfold.plans.views import MINUTE, table
from starfold.streaming import ingest as S

SCHEMA = "id long, owner long, ts timestamp, star int"


def _event_files(spark, d) -> str:
    path = scratch(spark, "arriving")
    e = views.items(spark, d).select("id", "owner", F.timestamp_micros("t").alias("ts"), "star")
    e.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    return path


@query("s1_stream_new_files", "SELECT id, owner, CAST(star AS BIGINT) AS star FROM items")
def s1(spark, d):
    src, out, ck = _event_files(spark, d), scratch(spark, "taken"), scratch(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        S.stream_new_files(spark, src, SCHEMA, out, ck, quiet_seconds=0.0)
    return S.read_done(spark, out).select("id", "owner", "star")


@query("s2_incremental_upsert", """SELECT id, 'v1' AS version, CAST(star + 10 AS BIGINT) AS label, star * 2.0::DOUBLE AS artefact, CASE WHEN id % 2 = 0 THEN 'first' ELSE 'second' END AS made FROM items""")
def s2(spark, d):
    path = scratch(spark, "store")
    i = views.items(spark, d).select("id", F.lit("v1").alias("version"), F.col("star").alias("label"), "star")

    def make(tag):
        return lambda df: df.select("id", "version", "label", (F.col("star") * 2.0).alias("artefact"), F.lit(tag).alias("made"))

    later = i.withColumn("label", F.col("label") + 10)
    S.incremental_upsert(i.where("id % 2 = 0"), path, "id", "version", make("first"), ["label"])
    S.incremental_upsert(later, path, "id", "version", make("second"), ["label"])
    out, computed = S.incremental_upsert(later, path, "id", "version", make("third"), ["label"])
    if computed:
        raise RuntimeError("a repeated run computed rows")
    return out


@query("s3_resume_guard", "SELECT 'events' AS name, count(*) AS rows, 'same' AS status FROM events UNION ALL SELECT 'orders', count(*), 'same' FROM orders")
def s3(spark, d):
    path = scratch(spark, "identity")
    inputs = {"events": table(spark, d, "events"), "orders": table(spark, d, "orders")}
    S.resume_guard(spark, path, inputs)
    return S.resume_guard(spark, path, inputs)


@query("s4_session_segments", """WITH s AS (SELECT owner, t, sum(CASE WHEN dt > 36000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY t, id) AS seg FROM (SELECT *, t - lag(t) OVER (PARTITION BY owner ORDER BY t, id) AS dt FROM items))
  SELECT owner, count(*) AS n, min(t) AS first, max(t) AS last FROM s GROUP BY owner, seg""")
def s4(spark, d):
    src, out, ck = _event_files(spark, d), scratch(spark, "sessions"), scratch(spark, "sessions-progress")
    # a closing row far behind the last one moves the watermark past every session; its own stays open
    last = views.items(spark, d).agg(F.max("t").alias("t"))
    end = last.select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("owner"), F.timestamp_micros(F.col("t") + 7 * 1440 * MINUTE).alias("ts"), F.lit(0).alias("star"))
    end.withColumn("day", F.lit("9999-12-31")).write.mode("append").partitionBy("day").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
    seg = S.session_segments(stream, "owner", "ts", "600 minutes", late="1 hour")
    seg.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.parquet(out)
    if closed.isEmpty() and not views.items(spark, d).isEmpty():
        raise RuntimeError("the stream closed no session")
    return closed.select("owner", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))
