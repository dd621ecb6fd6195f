"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents in hash order, end to end, cut into blocks of equal word counts.  The
schedule deals slots to sources by the van der Corput sequence: point ``n`` of the sequence falls into the source whose
part of the cumulative weights holds it, so any stretch of slots has every source near its weight.  The ``k``-th slot of
a source takes its ``k``-th block, and starts again from the first block when the stream is used up.

The points are not looked up one by one.  Among the ``2^b`` points ``reverse(n) / 2^b`` a source owns the integers of its
interval, so it lists them and reverses the bits to get its slot numbers: no join of slots with intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import hash_int
from starfold.llm.common import checkpoint, join_small, running, word_count

SEED = "mix"
BLOCK_WORDS = 512
CHUNK = 1 << 14  # points that one row lists at a time


@dataclass
class Mix:
    """``sources``: one row per source; ``schedule``: one row per slot; ``pieces``: words of a document in a block, with the slots that take them."""

    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    empty: DataFrame


def water_level(sources: DataFrame, total: float, cap: float) -> float:
    """Level ``v`` at which ``sum(min(cap * size, v * weight))`` reaches ``total``; each round shares the excess of full sources anew."""
    level, full = 0.0, -1
    while True:
        held = (F.col("size") * cap) <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(held.cast("long")), F.sum(F.when(held, F.col("size"))), F.sum(F.when(~held, F.col("weight")))).first()
        if row[0] == full or not row[2]:
            return level if row[2] else max(level, cap * total)
        full, level = row[0], (total - cap * (row[1] or 0)) / row[2]


def shares(sizes: DataFrame, weights: tuple[int, ...], ratio: float, cap: float) -> tuple[DataFrame, int]:
    """One row per source: rank ``src`` by code point (null last), documents, size, weight, target, and the words it gives."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    found = running(found, [F.col("source").isNull(), "source"], out="src")
    found = checkpoint(found.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))))
    n, total = found.agg(F.count(F.lit(1)), F.sum("size")).first()
    level = water_level(found, ratio * (total or 0), cap) if total else 0.0
    target = F.least(F.col("size") * F.lit(float(cap)), F.col("weight") * F.lit(level))
    return found.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 1e-6).cast("long")), n


def reversed_bits(value: Column, bits: int) -> Column:
    """The integer whose ``bits`` binary digits are those of ``value`` backwards."""
    return F.conv(F.reverse(F.lpad(F.bin(value), bits, "0")), 2, 10).cast("long")


def slots(sources: DataFrame, n_slots: int) -> DataFrame:
    """``(src, slot)`` of the first ``n_slots`` van der Corput points; ``sources`` has ``quota`` and ``first``, the quotas before it."""
    bits = max(1, (n_slots - 1).bit_length())
    edge = lambda c: F.ceil(c / F.lit(float(max(1, n_slots))) * F.lit(float(1 << bits))).cast("long")
    own = sources.where("quota > 0").select("src", edge(F.col("first")).alias("lo"), (edge(F.col("first") + F.col("quota")) - 1).alias("hi")).where("lo <= hi")
    chunks = own.select("src", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {CHUNK}"), F.expr(f"hi div {CHUNK}"))).alias("c"))
    chunks = chunks.repartition("src", "c").select("src", F.explode(F.sequence(F.greatest("lo", F.col("c") * CHUNK), F.least("hi", F.col("c") * CHUNK + CHUNK - 1))).alias("p"))
    return chunks.select("src", reversed_bits(F.col("p"), bits).alias("slot")).where(F.col("slot") < n_slots)


def mix(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, seed: str = SEED) -> Mix:
    """Mix ``sizes`` (doc_id, source, size in words) so that sources share ``ratio`` of all words by weight.

    Weights go round the sources in code-point order, null last, and count as one source.  No target exceeds ``cap`` times
    the source's size (at most 2); the excess is shared again by weight.  ``schedule`` has slot, src, pass, block and the
    word range ``[w_from, w_to)`` of the source's stream; ``pieces`` has one row per document and block with its range in the
    stream and the words that are taken.  Sizes that are null or 0 take part in nothing and are kept in ``empty``.

    The number of points in an interval differs from its exact share by a few; surplus slots are left out and missing ones
    are added after the last slot, and the last block of a source is cut, so a source gives its target to within a word.
    Repeated rows are separate documents.  An empty table gives empty results.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must be in (0, 2]")
    sizes = checkpoint(sizes.select("doc_id", "source", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size")))
    sources, n = shares(sizes, weights, ratio, cap)
    blocks = F.ceil(F.col("size") / block_words).cast("long")
    twice = blocks + F.ceil((F.col("words") - F.col("size")) / block_words).cast("long")
    sources = sources.withColumns({"blocks": blocks, "quota": F.when(F.col("words") <= F.col("size"), F.ceil(F.col("words") / block_words).cast("long")).otherwise(twice)})
    sources = running(sources, ["src"], F.col("size"), out="begin")
    sources = checkpoint(running(sources, ["src"], F.col("quota"), out="first"))
    n_slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    dealt = running(slots(sources, n_slots), ["src", "slot"], out="at")
    counted = dealt.groupBy("src").agg(F.min("at").alias("at0"), F.count(F.lit(1)).alias("got"))
    sources = checkpoint(sources.join(counted, "src", "left").fillna(0, ["at0", "got"]))
    ranked = join_small(dealt, sources.drop("source"), n, "src").withColumn("k", F.col("at") - F.col("at0")).where("k < quota")
    more = sources.where("got < quota").withColumn("k", F.explode(F.sequence("got", F.col("quota") - 1))).withColumn("slot", F.lit(n_slots) + F.col("first") + F.col("k"))
    cols = ["slot", "src", "k", "blocks", "words", "size"]
    schedule = ranked.select(*cols).unionByName(more.select(*cols))
    w_from = F.expr("k % blocks") * block_words
    last = F.least("size", F.when(F.expr("k div blocks") == 0, F.col("words")).otherwise(F.col("words") - F.col("size")))
    schedule = schedule.select("slot", "src", F.expr("k div blocks").alias("pass"), F.expr("k % blocks").alias("block"), w_from.alias("w_from"), F.least(w_from + block_words, last).alias("w_to"))

    own = sources.select("src", "source", F.col("size").alias("source_size"), "target", "begin")
    docs = join_small(sizes, own.withColumnRenamed("source", "__s"), n, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    docs = docs.withColumn("__u", hash_int(seed, "doc_id"))
    placed = running(docs.where("size > 0"), ["src", "__u", "doc_id", "size"], F.col("size"), out="w_start").withColumn("w_start", F.col("w_start") - F.col("begin")).drop("__u", "begin")
    cut = placed.withColumn("block", F.explode(F.sequence(F.expr(f"w_start div {block_words}"), F.expr(f"(w_start + size - 1) div {block_words}"))))
    overlap = F.least(F.col("w_start") + F.col("size"), "w_to") - F.greatest("w_start", "w_from")
    pieces = cut.join(schedule, ["src", "block"], "left").withColumn("taken", F.when(F.col("slot").isNotNull(), F.greatest(overlap, F.lit(0))).otherwise(F.lit(0)))
    return Mix(sources, schedule, pieces, docs.where("size = 0").drop("__u", "begin"))


def taken_words(mixed: Mix) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and the words that the mix takes from it."""
    key = ["doc_id", "source", "size", "source_size", "target"]
    got = mixed.pieces.groupBy("src", "w_start", *key).agg(F.sum("taken").alias("taken")).select(*key, "taken")
    return got.unionByName(mixed.empty.select(*key, F.lit(0).cast("long").alias("taken")))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source and word count of each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: each document as often as the mix takes it.

    A source's words are a run of its stream, so all documents but those at the two ends of the run are taken whole, once or
    twice; the cut ones are kept when at least half of a copy is taken.  Rows that repeat (doc_id, source and size equal) share
    their words evenly.  Documents without words have nothing to take and go.
    """
    taken = taken_words(mix(sizes_of(docs), **options)).where("taken > 0")
    copies = taken.groupBy("doc_id", "source", "size").agg(F.round(F.sum("taken") / F.count(F.lit(1)) / F.max("size")).cast("int").alias("__copies"))
    copies = copies.where("__copies > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), "__copies")
    d = docs.withColumn("__w", word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__w") == F.col("__n"))
    return d.join(copies, same).withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
