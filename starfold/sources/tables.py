"""Sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.core import as_list
from starfold.operators.gates import GateError, content_fingerprint
from starfold.operators.summary import file_extension

# Extensions that count as images.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "heif", "heic", "hif", "arw"]
MANIFEST_SCHEMA = (
    "dbPath string, enhance struct<enabled: boolean>, concurrency int, retouchedList string, excludeKeywords array<string>, "
    "folders array<struct<path: string, recursive: boolean, eventLabel: string, subjectLabel: string>>"
)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read-only load of a store table; a given schema is projected and cast, absent columns become NULL."""
    df = spark.read.format(fmt).load(path)
    if schema is None:
        return df
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def import_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """One-time import of a store table over JDBC, split on a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.options(**options).load()


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None, header: bool = True, comment: str | None = "#") -> DataFrame:
    """CSV / TSV with header, ``#`` comment lines and an optional byte order mark before the first column name."""
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", "UTF-8")
    if comment:
        reader = reader.option("comment", comment)
    if not header:
        return reader.schema(schema).csv(path)
    df = reader.csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if schema is None:
        return df
    fields = T.StructType.fromDDL(schema).fields
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else F.col(f.name)
    return df.select(*[cast(f).alias(f.name) for f in fields])


def parse_manifest(df: DataFrame, text: str, keep=()) -> DataFrame:
    """Manifest documents (with ``//`` comment lines) to one row per folder."""
    clean = F.regexp_replace(F.col(text), r"(?m)^\s*//.*$", "")
    doc = df.select(*keep, F.from_json(clean, MANIFEST_SCHEMA).alias("m"))
    rows = doc.select(*keep, F.col("m.excludeKeywords").alias("exclude_keywords"), F.posexplode("m.folders").alias("folder_ix", "f"))
    return rows.select(
        *keep, "exclude_keywords", "folder_ix", F.col("f.path").alias("path"), F.coalesce("f.recursive", F.lit(False)).alias("recursive"),
        F.coalesce("f.eventLabel", F.lit("")).alias("event"), F.col("f.subjectLabel").alias("subject"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read manifest files."""
    return parse_manifest(spark.read.text(path, wholetext=True), "value")


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True, extensions: list[str] = IMAGE_EXTENSIONS, skip_prefix: str = "._") -> DataFrame:
    """I4: files under the roots with a listed extension; only names, sizes and times are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(roots).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.withColumn("name", name).withColumn("extension", file_extension(F.col("path")))
    return files.where(F.col("extension").isin([e.lower() for e in extensions]) & ~F.col("name").startswith(skip_prefix))


def dataset_name(path, extension: str):
    """File name of a data set: of the file itself, or of the outermost folder ``<name>.<extension>`` that it is a part of."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(path, rf"([^/]+\.{extension})(?:/.*)?$", 1)


def resolve_paths(items: DataFrame, roots: DataFrame, listing: DataFrame, key: str, event: str, rel: str, formats: str) -> DataFrame:
    """First existing ``root/rel``: roots of the item's event in order, then all roots; a JPG sibling is preferred
    when the item has one.  Items without a file keep a NULL path (the missing report).

    ``roots`` is (event, root, root_ix); ``listing`` is (path).  The join goes from files to items by relative path,
    so items are not multiplied by roots.
    """
    r = roots.groupBy("root").agg(F.min("root_ix").alias("root_ix"), F.collect_set(event).alias("__events"))
    depth = F.size(F.split("root", "/"))
    by_depth = r.withColumn("__depth", depth)
    depths = by_depth.agg(F.collect_set("__depth").alias("__ds"))
    parts = F.split("path", "/")
    cut = listing.select("path").crossJoin(F.broadcast(depths)).withColumn("__depth", F.explode("__ds"))  # one row
    cut = cut.withColumn("root", F.array_join(F.slice(parts, 1, F.col("__depth")), "/"))
    cut = cut.withColumn("__rel", F.array_join(F.expr("slice(split(path, '/'), __depth + 1, greatest(size(split(path, '/')) - __depth, 0))"), "/"))
    known = cut.join(by_depth, ["root", "__depth"]).select("root", "root_ix", "__events", "__rel", "path")
    exact = items.select(key, event, F.col(rel).alias("__rel"), formats)
    hit = exact.join(known, "__rel")
    own = F.array_contains("__events", F.col(event))
    best = hit.groupBy(key).agg(F.min(F.struct((~own).cast("int").alias("foreign"), "root_ix", "path", "root")).alias("b"))
    base = items.join(best, key, "left").withColumn("__stem", F.regexp_replace("b.path", r"\.[^./]*$", ""))
    wants = F.array_contains(F.split(F.lower(formats), r"\|"), "jpg")
    sib = listing.select(F.col("path").alias("__jpg")).where(F.lower("__jpg").endswith(".jpg")).withColumn("__stem", F.regexp_replace("__jpg", r"\.[^./]*$", ""))
    sib = sib.groupBy("__stem").agg(F.min("__jpg").alias("__jpg"))
    j = base.join(sib, "__stem", "left")
    path = F.when(wants & F.col("__jpg").isNotNull(), F.col("__jpg")).otherwise(F.col("b.path"))
    return j.select(key, event, path.alias("path"), F.coalesce(F.col("b.foreign") == 1, F.lit(False)).alias("fallback"))


def upsert(target: DataFrame, source: DataFrame, key, overwrite: list[str], keep_if_null: list[str] = ()) -> DataFrame:
    """New snapshot: source values win in ``overwrite``; in ``keep_if_null`` a NULL keeps the old value; other columns stay."""
    key = as_list(key)
    s = source.select(*key, *[F.col(c).alias(f"__s_{c}") for c in (*overwrite, *keep_if_null)], F.lit(1).alias("__src"))
    j = target.join(s, key, "full_outer")
    new = {c: F.when(F.col("__src") == 1, F.col(f"__s_{c}")).otherwise(F.col(c)) for c in overwrite}
    new |= {c: F.coalesce(f"__s_{c}", c) for c in keep_if_null}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in target.columns])


def merge_into(spark: SparkSession, target_table: str, source: DataFrame, key, overwrite: list[str], keep_if_null: list[str] = ()) -> None:
    """The same as ``MERGE INTO`` for a target format that supports it."""
    key = as_list(key)
    source.createOrReplaceTempView("starfold_source")
    sets = [f"t.`{c}` = s.`{c}`" for c in overwrite] + [f"t.`{c}` = coalesce(s.`{c}`, t.`{c}`)" for c in keep_if_null]
    cols = [*key, *overwrite, *keep_if_null]
    names, values = ", ".join(f"`{c}`" for c in cols), ", ".join(f"s.`{c}`" for c in cols)
    cond = " AND ".join(f"t.`{k}` = s.`{k}`" for k in key)
    spark.sql(f"MERGE INTO {target_table} t USING starfold_source s ON {cond} WHEN MATCHED THEN UPDATE SET {', '.join(sets)} "
              f"WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})")


def evolve_schema(target: DataFrame, schema: str) -> DataFrame:
    """Add missing columns as NULL; existing columns are never dropped or retyped."""
    have = set(target.columns)
    add = [f for f in T.StructType.fromDDL(schema).fields if f.name not in have]
    return target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in add])


def backfill(df: DataFrame, col: str, value, where: Column) -> DataFrame:
    """I8: fill only NULLs where the rule holds."""
    return df.withColumn(col, F.coalesce(F.col(col), F.when(where, F.lit(value))))


def write_once(df: DataFrame, path: str) -> str:
    """Write a new output; an existing one must have the same content (``unchanged``), else refuse."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return "written"
    same = sorted(old.columns) == sorted(df.columns) and content_fingerprint(old).first() == content_fingerprint(df).first()
    if not same:
        raise GateError(f"refusing to change {path}")
    return "unchanged"


def write_scores(df: DataFrame, path: str, key: str, cols: list[str]) -> None:
    """Score table."""
    df.select(key, *cols).write.mode("errorifexists").parquet(path)


def write_pairs(pairs: DataFrame, path: str, split: str = "split") -> None:
    """Pair table partitioned by split; rows are clustered by split and a salt so a big split is many files."""
    pairs.repartition(F.col(split), F.spark_partition_id() % 64).write.partitionBy(split).mode("errorifexists").parquet(path)


def label_and_key(tasks: DataFrame, blind: list[str]) -> tuple[DataFrame, DataFrame]:
    """The blind sheet and the answer key as two projections of one frame."""
    return tasks.select(*blind), tasks


def write_labels_and_key(tasks: DataFrame, blind: list[str], label_path: str, key_path: str) -> None:
    """Blind sheet and key as separate outputs."""
    sheet, key = label_and_key(tasks, blind)
    sheet.write.mode("errorifexists").option("header", True).csv(label_path)
    key.write.mode("errorifexists").parquet(key_path)


def extend_latent(base: DataFrame, clusters: DataFrame, key: str, rating: str) -> DataFrame:
    """Append rows of unseen items with the constant mapped from their rating and a NULL score."""
    g = base.groupBy(rating).agg(F.avg("g").alias("g"))
    new = clusters.join(base.select(key), key, "left_anti").join(g, rating, "left")
    return base.unionByName(new.select(*[c for c in base.columns if c in (*clusters.columns, "g")]), allowMissingColumns=True)


def merge_batches(batches: dict[str, tuple[DataFrame, DataFrame]], gid: str, on, split: str | None = "split", wanted: str = "test") -> DataFrame:
    """Union of (key, readback) batches with a batch tag, only groups of the wanted split, missing columns NULL."""
    out = None
    for name, (key, labels) in sorted(batches.items()):
        k = key if split is None or split not in key.columns else key.join(key.where(F.col(split) == wanted).select(gid).distinct(), gid, "left_semi")
        extra = [c for c in labels.columns if c not in k.columns or c in as_list(on)]
        part = k.join(labels.select(*extra), as_list(on)).withColumn("batch", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def discover_version(features: DataFrame, version: str, known: list[str]) -> DataFrame:
    """Versions outside ``known`` with their row counts; ``chosen`` marks the only one, none if there are several."""
    v = features.where(~F.col(version).isin(known)).groupBy(version).agg(F.count(F.lit(1)).alias("rows"))
    n = v.agg(F.count(F.lit(1)).alias("__n"))
    return v.crossJoin(F.broadcast(n)).select(version, "rows", (F.col("__n") == 1).alias("chosen"))  # one row
