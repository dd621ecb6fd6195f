"""Incremental ingest as Structured Streaming."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.core import as_list
from starfold.operators.gates import GateError, content_fingerprint, snapshot_tables, verify_snapshot
from starfold.sources.tables import upsert


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_done(spark: SparkSession, out: str) -> DataFrame | None:
    """Rows taken so far, across all batches."""
    return _read_or_none(spark, os.path.join(out, "rows"))


def stream_new_files(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, quiet_seconds: float = 3.0, files_per_batch: int = 32,
                     process: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet") -> None:
    """Take files as they arrive, at most ``files_per_batch`` per batch, only after a quiet period; stop when all are seen.

    A file that changed less than ``quiet_seconds`` ago is put on a backlog by name and read by a later call, when it
    has become quiet.  Progress lives in the checkpoint and in the output, one folder per batch, so a restart or a
    repeated batch adds nothing twice.
    """
    rows_dir, late_dir = os.path.join(out, "rows"), os.path.join(out, "pending")
    work = process or (lambda df: df)
    quiet = F.expr(f"current_timestamp() - make_dt_interval(0, 0, 0, {quiet_seconds})")
    ready = F.col("__changed") <= quiet

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(os.path.join(rows_dir, f"batch={name}"))

    backlog = _read_or_none(spark, late_dir)
    if backlog is not None:
        taken = _read_or_none(spark, rows_dir)
        names = backlog.select("source_file").distinct()
        if taken is not None:
            names = names.join(taken.select("source_file").distinct(), "source_file", "left_anti")
        paths = [r[0] for r in names.toLocalIterator()]  # names of files that were still being written, a short list
        if paths:
            late = spark.read.schema(schema).format(fmt).load(paths)
            late = late.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("__changed")).where(ready)
            if not late.isEmpty():
                key = late.select("source_file").distinct().agg(F.hex(F.bit_xor(F.xxhash64("source_file")))).first()[0]
                write(work(late.drop("__changed")), f"late-{key}")

    def batch(df: DataFrame, batch_id: int) -> None:
        late = df.where(~ready).select("source_file").distinct()
        late.write.mode("overwrite").parquet(os.path.join(late_dir, f"batch={batch_id}"))
        fresh = df.join(spark_read_pending(df.sparkSession, late_dir, batch_id), "source_file", "left_anti").drop("__changed")
        write(work(fresh), str(batch_id))

    def spark_read_pending(session: SparkSession, path: str, batch_id: int) -> DataFrame:
        return session.read.schema("source_file string").parquet(os.path.join(path, f"batch={batch_id}"))

    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(source)
    stream = stream.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("__changed"))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def missing_artefacts(source: DataFrame, store: DataFrame | None, key, version: str) -> DataFrame:
    """Source rows whose (key, version) artefact is not stored yet."""
    return source if store is None else source.join(store.select(*as_list(key), version), [*as_list(key), version], "left_anti")


def incremental_upsert(source: DataFrame, path: str, key, version: str, compute: Callable[[DataFrame], DataFrame], overwrite: list[str],
                       keep_if_null: list[str] = ()) -> tuple[DataFrame, int]:
    """Compute only missing artefacts, refresh the label columns always; returns (new snapshot, computed rows).

    The store is a folder of numbered snapshots; the new one is written beside the old and then its number is committed,
    so a lost job leaves the old state valid.  A repeated run computes nothing and changes nothing.
    """
    spark = source.sparkSession
    current = latest_snapshot(spark, path)
    number = -1 if current is None else current[0]
    store = None if current is None else current[1]
    missing = missing_artefacts(source, store, key, version)
    computed = compute(missing)
    keys = [*as_list(key), version]
    if store is None:
        result = computed
    else:
        labels = source.select(*keys, *overwrite, *keep_if_null).join(store.select(*keys), keys, "left_semi")
        result = upsert(store, labels, keys, overwrite, keep_if_null).unionByName(computed, allowMissingColumns=True)
    target = _snapshot_path(path, number + 1)
    result.write.mode("overwrite").parquet(target)
    spark.range(number + 1, number + 2).toDF("number").coalesce(1).write.mode("append").parquet(os.path.join(path, "commits"))
    out = spark.read.parquet(target)
    done = out.count() - (0 if store is None else store.count())
    return out, done


def latest_snapshot(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """The highest snapshot that was committed: its number is in the commit table, written after the data."""
    commits = _read_or_none(spark, os.path.join(path, "commits"))
    if commits is None:
        return None
    number = commits.agg(F.max("number")).first()[0]
    return number, spark.read.parquet(_snapshot_path(path, number))


def _snapshot_path(path: str, number: int) -> str:
    return os.path.join(path, f"data-{number:08d}")


def resume_guard(spark: SparkSession, identity_path: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """S3: before a restart: stored input fingerprints must equal the current ones; the first run stores them."""
    now = snapshot_tables(inputs)
    stored = _read_or_none(spark, identity_path)
    if stored is None:
        now.write.mode("errorifexists").parquet(identity_path)
        return verify_snapshot(spark.read.parquet(identity_path), now)
    report = verify_snapshot(stored, now)
    bad = [r["name"] for r in report.where("status <> 'same'").collect()]  # one row per named input
    if bad:
        raise GateError(f"inputs changed since the first run: {bad}")
    return report


def outputs_unchanged(before: DataFrame, after: DataFrame) -> bool:
    """S3: equal content fingerprints."""
    return content_fingerprint(before).first() == content_fingerprint(after).first()


def session_segments(stream: DataFrame, by, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """Streaming segments per group: a session closes when no row came for the gap; late rows within the watermark count."""
    d = stream.withWatermark(ts, late)
    g = d.groupBy(*as_list(by), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return g.drop("w")
