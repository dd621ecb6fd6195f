"""Line deduplication over all documents, by built-in expressions only.

Every text is exploded into lines, a line's key is hashed to 128 bits, distinct documents are counted per hash, and the lines
of hashes over the threshold are dropped from all documents but the first one.  Only hashes, ids and positions are shuffled
for that; texts meet their dropped positions once, and the other lines are put together by position.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import bind
from starfold.llm.common import SPACES, checkpoint

MIN_CHARS, MIN_DOCS = 10, 2


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with lower-case A-Z; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(SPACES)), ascii_uppercase, ascii_lowercase)


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, k1, k2) of every line whose key has ``min_chars`` code points: the text's hash, the line number and the key's hash."""
    lines = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return lines.where(F.char_length("key") >= min_chars).select("doc_id", "th", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines whose numbers are not in ``dropped``, joined again; linear in the number of lines."""
    rest = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), dropped)
    return bind(lines, lambda x: F.array_join(F.transform(rest(x), lambda i: F.get(x, i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text without the dropped lines).

    A key of at least ``min_chars`` code points that is found in at least ``min_docs`` documents keeps its lines only in the
    document with the smallest id.  Documents are told apart by doc_id: repeated rows of an id are one document and get equal
    results; all null ids are one document that comes after all others.  Null and empty texts are one empty line.  A text
    whose lines all go becomes empty.  Columns other than doc_id and text are not read, so their names cannot clash.

    A line of a third of all documents is one row per task before the counts are shuffled.  The keys over the threshold are a
    written table, so its rows meet their key in a plain join of two tables, which adaptive execution splits where it is skewed.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    lines = checkpoint(line_table(d, min_chars))
    holders = lines.select("k1", "k2", "doc_id").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first"))
    shared = checkpoint(holders.where(F.col("n_docs") >= min_docs).select("k1", "k2", "first"))
    gone = lines.join(shared, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__h")).agg(F.collect_set("pos").alias("dropped"))
    both = d.join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__h")), "left")
    split = F.split("text", "\n", -1)
    return both.select(
        "doc_id", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept_lines(split, F.col("dropped"))).alias("kept"))
