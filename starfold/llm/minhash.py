"""Near-duplicate documents by MinHash: one-permutation sketches, banded buckets, star edges, and exact confirmation.

1. Every whole text becomes a set of word shingles and a sketch (``shingles.Sketcher``).  Texts with equal sets are one node.
2. In every bucket of a band the smallest node is the centre of a star; only centre-member pairs become candidates, so a
   bucket of ``m`` nodes gives ``m - 1`` pairs, and the same centre in several bands gives them once.
3. Candidates are confirmed on full sets; links join nodes into components.
4. A star can miss a link between two members that its centre does not bear out.  Buckets whose members are still in more
   than one component are therefore compared exactly, block by block, inside tasks: common shingles of two blocks of sets are
   counted by a matrix product, and only links that join components leave the task.  Buckets whose centres
   are linked hold mostly the same members and are compared together, so a set is sent about once and not once per band.

The bands follow from the threshold: a pair at it shares no bucket with a probability of at most ``MISS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.common import checkpoint
from starfold.llm.shingles import Sketcher, hold_words, shingle_set, similar
from starfold.llm.workers import hold, slices
from starfold.operators.clusters import connected_components

WIDTH, PERCENT = 5, 80
BINS = 256  # most bins of a sketch
MISS = 1e-8
BLOCK_SETS = 1024  # members of a bucket that one task holds, twice over
BLOCK_SHINGLES = 2_000_000
KEPT_SETS = 512  # sets that a confirming worker keeps
TILE = 1 << 21  # cells of an incidence tile


def banding(percent: int, bins: int = BINS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose buckets still miss a pair at the threshold with at most ``miss``."""
    same = percent / 100
    fit = [r for r in range(1, 33) if (1 - same**r) ** (bins // r) <= miss]
    if not fit:
        raise ValueError("more bins are needed for this threshold")
    return bins // max(fit), max(fit)


def prepared(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """rid, doc_id, text hash, shingle count, set hash (null for an empty set) and band keys, in the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        sketcher = Sketcher(bands, rows)
        for part in slices(batches):
            sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
            keys = sketcher.keys(sketcher.sketches(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))],
                ["doc_id", "text_hash", "n_shingles", "set_hash", "bands"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    out = cols.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash binary, bands array<long>")
    return checkpoint(out.withColumn("rid", F.monotonically_increasing_id()))


def with_text(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of nodes given as (node, doc_id, text_hash); repeated rows of a document count once per row."""
    cols = docs.select(F.col("doc_id").cast("long").alias("__d"), F.col("text").cast("string").alias("text")).withColumn("__h", F.xxhash64("text"))
    found = cols.join(nodes, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("text_hash")))
    return found.select("node", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (src, dst) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        kept: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) >= KEPT_SETS:
                    kept.clear()
                kept[node] = shingle_set(text, width)
            return kept[node]

        for batch in batches:
            for part in slices([batch], "b"):
                src, dst, a, b = (part.column(c).to_pylist() for c in ("src", "dst", "a", "b"))
                hit = [i for i in range(len(src)) if similar(of(src[i], a[i]), of(dst[i], b[i]), percent)]
                yield pa.RecordBatch.from_arrays([pa.array([src[i] for i in hit], pa.int64()), pa.array([dst[i] for i in hit], pa.int64())], ["src", "dst"])

    first = pairs.join(texts.select(F.col("node").alias("src"), F.col("text").alias("a")), "src")
    both = first.join(texts.select(F.col("node").alias("dst"), F.col("text").alias("b")), "dst")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each set of ``a`` with each of ``b``, by tiles of a 0/1 incidence product."""
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ids_a, ids_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    at_a, at_b = np.minimum(np.searchsorted(shared, ids_a), len(shared) - 1), np.minimum(np.searchsorted(shared, ids_b), len(shared) - 1)
    in_a, in_b = shared[at_a] == ids_a, shared[at_b] == ids_b
    rows_a, at_a, rows_b, at_b = rows_a[in_a], at_a[in_a], rows_b[in_b], at_b[in_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    rows_a, at_a, rows_b, at_b = rows_a[order_a], at_a[order_a], rows_b[order_b], at_b[order_b]
    step = max(1, TILE // max(len(a), len(b)))
    for lo in range(0, len(shared), step):
        tiles = []
        for rows, at, n in ((rows_a, at_a, len(a)), (rows_b, at_b, len(b))):
            i, j = np.searchsorted(at, lo), np.searchsorted(at, lo + step)
            tile = np.zeros((n, min(step, len(shared) - lo)), np.float32)
            tile[rows[i:j], at[i:j] - lo] = 1
            tiles.append(tile)
        out += tiles[0] @ tiles[1].T
    return out


def joining_links(nodes: list[int], comps: list[int], sets: list[np.ndarray], other: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between two halves of a block pair (``other``: rows of the second; both all true for one block) that join components."""
    first, second = other
    left, right = np.flatnonzero(first), np.flatnonzero(second)
    if not len(left) or not len(right):
        return []
    root: dict[int, int] = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    size = np.array([len(s) for s in sets], np.float64)
    common = common_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
    close = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
    label = np.array(comps)
    close &= label[left][:, None] != label[right][None, :]
    out = []
    for i, j in zip(*np.nonzero(close), strict=True):
        a, b = find(comps[left[i]]), find(comps[right[j]])
        if a != b:
            root[a] = b
            out.append((nodes[left[i]], nodes[right[j]]))
    return out


def blocks_of(rows: Column, shingles: Column) -> Column:
    """Number of blocks for a group, so that a block's sets fit in a task twice over."""
    return F.greatest(F.ceil(rows / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES)).cast("long")


def grouped(members: DataFrame) -> DataFrame:
    """The groups in which the members of buckets (key, centre, node, comp, n) are compared: level, gid, blocks, node, comp.

    Buckets with one centre have mostly the same members, and a centre is mostly a member of buckets with a smaller centre, its
    root.  All buckets of a root, or else of a centre, become one group where this sends fewer rows, so a pair that meets in
    many bands is compared once; other buckets are groups of their own.  Every pair that shares a bucket shares a group.
    """
    root = members.groupBy(F.col("node").alias("centre")).agg(F.min("centre").alias("root"))
    levels = checkpoint(members.select("key", "centre").distinct().join(root, "centre"))
    placed = members.select("key", "node", "n").join(levels, "key")

    def sized(by: str) -> DataFrame:
        found = placed.select(by, "node", "n").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
        return found.withColumn(f"{by}_blocks", blocks_of(F.col("m"), F.col("n"))).select(by, F.col(f"{by}_blocks"), (F.col("m") * F.col(f"{by}_blocks")).alias(f"{by}_rows"))

    plan = levels.join(sized("key"), "key").join(sized("centre"), "centre").join(sized("root"), "root")
    centres = plan.groupBy("root", "centre", "centre_rows").agg(F.sum("key_rows").alias("apart")).withColumn("least", F.least("apart", "centre_rows"))
    roots = centres.groupBy("root").agg(F.sum("least").alias("root_apart"))
    plan = plan.join(centres.select("centre", "apart"), "centre").join(roots, "root")
    level = F.when(F.col("root_rows") <= F.col("root_apart"), "root").when(F.col("centre_rows") <= F.col("apart"), "centre").otherwise("key")
    plan = plan.withColumn("level", level)
    pick = lambda end: F.when(F.col("level") == "root", F.col("root" + end)).when(F.col("level") == "centre", F.col("centre" + end)).otherwise(F.col("key" + end))
    plan = checkpoint(plan.select("key", "level", pick("").alias("gid"), pick("_blocks").alias("blocks")))
    return members.select("key", "node", "comp").join(plan, "key").select("level", "gid", "blocks", "node", "comp").distinct()


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) between components inside the groups of ``members`` (key, centre, node, comp, n); exact, in blocks of bounded size."""
    dealt = grouped(members).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("level", "gid", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "comp").join(sets, "node")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        hold("blocks of sets")
        lo, hi = key[2].as_py(), key[3].as_py()
        nodes, comps = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
        values = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        block = rows.column("block").to_numpy()
        found = joining_links(nodes, comps, values, (block == lo, block == hi), percent) if len(set(comps)) > 1 else []
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return paired.groupBy("level", "gid", "lo", "hi").applyInArrow(run, "src long, dst long")


def packed_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the sorted set as packed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_words()
        for part in slices(batches):
            sets = [shingle_set(t, width).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept, and ``first`` for one row of each component.

    Documents with ``100 * |a and b| >= percent * |a or b|`` on their sets of ``width``-word shingles are linked, directly or
    through others; ``component_id`` is the smallest doc_id of the component.  A document without words has an empty set and
    stays alone.  Null ids take part but name no component: a component of null ids only has a null id and keeps none.
    Repeated rows are separate rows with one component.  Columns other than doc_id and text are not read.
    """
    p = prepared(docs, width, *banding(percent))
    groups = p.where("n_shingles > 0").groupBy("set_hash").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"))
    groups = checkpoint(groups)
    reps = p.join(groups.select(F.col("node").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "node")

    banded = reps.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("__last")).where("centre < __last").drop("__last")
    sizes = reps.select(F.col("node").alias("centre"), F.col("n_shingles").alias("n_centre"))
    shared = checkpoint(shared.join(sizes, "centre"))  # a centre has at most one bucket a band
    buckets = checkpoint(banded.join(shared, "key"))

    stars = buckets.where("centre != node").select("centre", "node", "n", "n_centre").distinct()
    stars = checkpoint(stars.where(100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre")).select(F.col("centre").alias("src"), F.col("node").alias("dst")))
    place = reps.select("node", "doc_id", "text_hash")
    ends = stars.select(F.col("src").alias("node")).union(stars.select(F.col("dst").alias("node"))).distinct()
    links = checkpoint(confirmed(stars, with_text(docs, place.join(ends, "node", "left_semi")), width, percent))

    nodes = checkpoint(buckets.select(F.col("node").alias("id")).distinct())
    label = connected_components(links, nodes)
    named = buckets.select("key", "centre", "node", "n").join(label.select(F.col("id").alias("node"), F.col("component").alias("comp")), "node")
    mixed = named.groupBy("key").agg(F.min("comp").alias("__a"), F.max("comp").alias("__b")).where("__a < __b").select("key")
    members = checkpoint(named.join(mixed, "key"))
    ends = members.select("node").distinct()
    sets = checkpoint(packed_sets(with_text(docs, place.join(ends, "node", "left_semi")), width).dropDuplicates(["node"]))
    more = checkpoint(compared(members, sets, percent))
    label = connected_components(links.union(more), nodes)

    ids = groups.join(label.withColumnRenamed("id", "node"), "node", "left").select("set_hash", "node", "least", F.coalesce("component", "node").alias("comp"))
    names = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = ids.join(names, "comp").select("set_hash", "component_id", (F.col("node") == F.col("comp")).alias("__head"), F.col("node").alias("__node"))
    out = p.drop("bands").join(ids, "set_hash", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
                      F.when(alone, F.lit(True)).otherwise(F.col("__head") & (F.col("rid") == F.col("__node"))).alias("first"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component its first document, as one row.

    Documents without words are in no group and all stay.
    """
    firsts = near_duplicates(docs, **options).where("first").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), (F.col("n_shingles") == 0).alias("__alone"))
    firsts = firsts.dropDuplicates()
    d = docs.withColumn("__x", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__x") == F.col("__h"))
    kept = d.join(firsts, same).withColumn("__r", F.when(F.col("__alone"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", "__x", "__r"]).select(*docs.columns)
