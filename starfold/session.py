"""Session defaults for local runs and tests; on a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = "8", partitions: int = 8) -> SparkSession:
    """Local session with adaptive execution, UTC and no UI."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("starfold")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
