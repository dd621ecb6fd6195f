"""Document fingerprints by a randomised edit embedding.

A walk copies the text: at step ``t`` it writes the current character and moves on if a shared random bit of (t, character)
says so.  Two texts use the same bits, so after an edit their walks drift apart and, being random, soon meet again: a small
edit distance becomes a small Hamming distance between the written strings.  Texts are embedded in pieces of ``PIECE``
characters, each with the walk started anew, so that many walks run side by side and an edit stays in its neighbourhood.

A fingerprint samples ``CELLS`` places of the embedding.  The place of a cell is drawn from the text's length by a
consistent rule (a longer text keeps the place or moves it into its new part), so texts of different lengths agree on a
share of places that is the ratio of their lengths.  Equal bytes at equal cells estimate the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from starfold.llm.common import checkpoint
from starfold.llm.workers import slices

PIECE = 512  # characters per walk
RUN = 2  # written characters that a cell samples
CELLS = 128  # bytes of a fingerprint
BANDS, BAND_CELLS = 24, 4
SEED = 23
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Embedder:
    """Shared random bits and places; every instance with the same parameters is equal."""

    def __init__(self, cells: int = CELLS, piece: int = PIECE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.cells, self.piece = cells, piece
        self.bits = rng.integers(0, 2, (2 * piece, 256), dtype=np.uint8)
        self.keys = rng.integers(1, 1 << 63, cells, dtype=np.uint64)
        self.places: dict[int, np.ndarray] = {}

    def place(self, n: int) -> np.ndarray:
        """Sampled character of each cell for a text of ``n`` characters: consistent over lengths, uniform for each."""
        if n not in self.places:
            if len(self.places) > 50_000:
                self.places.clear()
            key, at, ahead = self.keys.copy(), np.zeros(self.cells, np.int64), np.zeros(self.cells, np.int64)
            live = ahead < n
            while live.any():
                at[live] = ahead[live]
                key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
                ahead[live] = ((at[live] + 1) * ((1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
                live = ahead < n
            self.places[n] = at
        return self.places[n]

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """One row of bytes per text; rows of empty texts are 0."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        pieces = -(-sizes // self.piece)
        first = np.cumsum(pieces) - pieces
        out = np.zeros((len(texts), self.cells), np.uint8)
        if not pieces.sum():
            return out
        wide = self.piece + 1  # the last column stays 0: the end of the piece
        flat = np.zeros((int(pieces.sum()), wide), np.uint8)
        ends = np.full(len(flat), self.piece, np.int64)
        for i, c in enumerate(codes):
            if len(c):
                low = ((c * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
                k, rest = divmod(len(c), self.piece)
                flat[first[i] : first[i] + k, : self.piece] = low[: k * self.piece].reshape(k, self.piece)
                if rest:
                    flat[first[i] + k, :rest] = low[k * self.piece :]
                    ends[first[i] + k] = rest
        base = np.arange(len(flat), dtype=np.int64) * wide
        at, last, cells = base.copy(), base + ends, flat.ravel()
        written = np.zeros((2 * self.piece + RUN, len(flat)), np.uint8)
        for t in range(2 * self.piece):
            now = cells.take(at)
            written[t] = now
            at += self.bits[t].take(now)
            np.minimum(at, last, out=at)
        for i, n in enumerate(sizes.tolist()):
            if n:
                place = self.place(n)
                step, col = 2 * (place % self.piece), first[i] + place // self.piece
                value = np.full(self.cells, i * 0, np.uint64)
                for k in range(RUN):
                    value = (value ^ written[step + k, col]) * _GOLD
                    value ^= value >> np.uint64(29)
                out[i] = (value >> np.uint64(56)).astype(np.uint8)
        return out


_embedder: list[Embedder] = []


def embedder() -> Embedder:
    """The default embedder, built once in a worker."""
    if not _embedder:
        _embedder.append(Embedder())
    return _embedder[0]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal cells of two fingerprints; empty texts (no bytes) are like each other and like nothing else."""
    if not a or not b:
        return float(a == b)
    return float(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) / len(a)


def of_texts(texts: list[str]) -> list[bytes]:
    """Fingerprints of whole texts; an empty text has the empty fingerprint."""
    return [x.tobytes() if t else b"" for t, x in zip(texts, embedder().fingerprints(texts), strict=True)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_chars and fingerprint (binary) of every whole text; null counts as empty.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(map(len, texts), pa.int64()), pa.array(of_texts(texts), pa.binary())], ["doc_id", "text_hash", "n_chars", "fingerprint"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    return cols.mapInArrow(run, "doc_id long, text_hash long, n_chars long, fingerprint binary")


# ---------------------------------------------------------------- edits with the next document

EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, role string, text string"


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of characters replaced by as many first ones of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _edit_rows(ids: list, texts: list[str], follow: list[str], prints: list[bytes], next_prints: list[bytes]) -> list[list]:
    changed = [edited(t, f) for t, f in zip(texts, follow, strict=True)]
    others = of_texts(changed)
    return [ids, [len(t) for t in texts], [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], prints, others,
            [likeness(a, b) for a, b in zip(prints, others, strict=True)], [likeness(a, b) for a, b in zip(prints, next_prints, strict=True)], ["done"] * len(ids), [None] * len(ids)]


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in EDIT_SCHEMA.split(", ")])


def _edit_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: every row but the last meets its successor here; the first and last texts are handed on."""
    held: tuple | None = None  # id, text, fingerprint of the row that waits for its successor
    for part in slices(batches):
        ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
        prints = of_texts(texts)
        if held is None:
            yield _batch([[ids[0]], [len(texts[0])], [None], [prints[0]], [None], [None], [None], ["head"], [texts[0]]])
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        held = ids[-1], texts[-1], prints[-1]
        if len(ids) > 1:
            yield _batch(_edit_rows(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]))
    if held is not None:
        yield _batch([[held[0]], [len(held[1])], [None], [held[2]], [None], [None], [None], ["tail"], [held[1]]])


def _tail_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the first text of the next partition."""
    for batch in batches:
        for part in slices([batch], "head_text"):
            ids, texts, heads = part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("head_text").to_pylist()
            yield _batch(_edit_rows(ids, texts, heads, part.column("fingerprint").to_pylist(), part.column("head_print").to_pylist()))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its text with the last quarter replaced from the next document.

    Documents follow each other by doc_id (nulls first, repeated ids by text hash); after the last comes the first.  Null
    texts are empty.  A single document is its own successor.  Texts are shuffled once, by range, and pairs of neighbours are formed
    inside the sorted partitions; only the first and last text of each partition are exchanged afterwards.
    """
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    order = ["doc_id", "__h"]
    ranged = cols.repartitionByRange(*order).sortWithinPartitions(*order).drop("__h")
    found = checkpoint(ranged.mapInArrow(_edit_run, EDIT_SCHEMA).withColumn("__p", F.spark_partition_id()))
    ends = found.where("role != 'done'")
    heads = ends.where("role = 'head'").select("__p", F.col("text").alias("head_text"), F.col("fingerprint").alias("head_print"))
    # one row per partition of the shuffle
    chain = ends.where("role = 'head'").select("__p")
    chain = chain.select("__p", F.lead("__p").over(W.orderBy("__p")).alias("__q"), F.min("__p").over(W.partitionBy(F.lit(1))).alias("__first"))
    chain = chain.select("__p", F.coalesce("__q", "__first").alias("__q"))
    tails = ends.where("role = 'tail'").join(chain, "__p").join(heads.withColumnRenamed("__p", "__q"), "__q")
    last = tails.select("doc_id", "text", "fingerprint", "head_text", "head_print").mapInArrow(_tail_run, EDIT_SCHEMA)
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return found.where("role = 'done'").select(*out).unionByName(last.select(*out))


# ---------------------------------------------------------------- near pairs


def edit_distance(a: str, b: str) -> int:
    """Edit distance by bit-parallel columns on long integers."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (~(diagonal | up) & full), up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (~(diagonal | more) & full), more & diagonal
    return score


def near_classes(docs: DataFrame, percent: int = 80, bands: int = BANDS, width: int = BAND_CELLS) -> DataFrame:
    """(doc_id, class_id): documents whose edit distance to the class's centre is at most ``100 - percent`` % of the longer text.

    Equal texts are one node.  Bands of sampled cells give buckets.  In rounds the smallest open node of each bucket becomes a
    centre and is verified against the open members; verified ones join its class, the others stay open for the next round, until
    every node is a centre or has joined one.  Candidates of a round are stars, never all pairs.  Null ids count as documents.
    Empty texts are one class.
    """
    prints = checkpoint(fingerprint(docs))
    nodes = prints.groupBy("text_hash", "fingerprint", "n_chars").agg(F.min("doc_id").alias("node"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("fingerprint"), k * width + 1, width)))
    open_ = checkpoint(nodes.where("n_chars > 0 and node is not null").select("node", "n_chars", F.explode(keys).alias("key")))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    own = checkpoint(nodes.where("node is not null").select("node", F.col("node").alias("class_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, m) for c, m, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True) if 100 * edit_distance(a, b) <= (100 - percent) * max(len(a), len(b))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.int64())], ["centre", "node"])

    while True:
        shared = open_.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("__last")).where("centre < __last").drop("__last")
        stars = checkpoint(open_.join(shared, "key"))
        if stars.isEmpty():
            break
        pairs = stars.where("centre != node").select("centre", "node").distinct()
        both = pairs.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("a")), "centre").join(texts.select("node", F.col("text").alias("b")), "node")
        joined = checkpoint(both.select("centre", "node", "a", "b").mapInArrow(run, "centre long, node long").groupBy("node").agg(F.min("centre").alias("centre")))
        own = checkpoint(own.join(joined, "node", "left").select("node", F.coalesce("centre", "class_id").alias("class_id")))
        served = stars.select(F.col("key"), F.col("centre").alias("node")).distinct()
        open_ = checkpoint(stars.drop("centre").join(served, ["key", "node"], "left_anti").join(joined, "node", "left_anti"))
    # a centre may itself have joined a smaller one: follow to the end
    while True:
        up = own.select(F.col("node").alias("class_id"), F.col("class_id").alias("__up"))
        own = checkpoint(own.join(up, "class_id").select("node", F.col("__up").alias("class_id"), (F.col("__up") != F.col("class_id")).alias("__moved")))
        if own.where("__moved").isEmpty():
            break
        own = own.drop("__moved")
    groups = nodes.join(own.drop("__moved"), "node").select("text_hash", "fingerprint", "class_id")
    return prints.join(groups, ["text_hash", "fingerprint"], "left").select("doc_id", "class_id")
