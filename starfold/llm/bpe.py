"""Byte-level BPE encoding and decoding.

Texts are cut into words by the vocabulary's published pattern.  A short word is encoded on a contiguous rank array: part
boundaries and the rank of each adjacent pair lie side by side, the smallest rank is found by a scan, its boundary is
deleted and the two neighbouring ranks are looked up anew.  Long words (one run of letters or signs of any length) use a
heap over linked parts, which gives the same merges without quadratic time.  A worker keeps the ids of words it has seen,
up to a bound; a document's ids are then one join of byte strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from starfold.llm.workers import hold, slices

# Fixed value: the published word pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORT_BYTES = 128  # longest word for the rank array; longer ones take the heap, with equal results
CACHE_WORDS = 400_000
NO_RANK = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class BytePairs:
    """Vocabulary with the encoder and decoder; ``spec`` is the text of a tokenizers JSON file of a byte-level BPE."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, vocab = data["model"], data["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = 1 + max([*vocab.values(), *(a["id"] for a in data["added_tokens"])])
        self.first = [vocab[c] for c in letters]
        self.rank = {vocab[a] * self.size + vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(byte_of.__getitem__, token))
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.words = self.pattern.findall
        self.marks = regex.compile("|".join(f"(?:{regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache = _Cache(self)

    def short(self, word: bytes) -> list[int]:
        """Ids of a short word."""
        first, size, made, get = self.first, self.size, self.made, self.rank.get
        parts = [first[b] for b in word]
        ranks = [get(a * size + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_RANK:
            i = ranks.index(best)
            parts[i] = made[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] * size + parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] * size + parts[i + 1], NO_RANK)
        return parts

    def long(self, word: bytes) -> list[int]:
        """Ids of a word of any length."""
        size, get = self.size, self.rank.get
        parts = [self.first[b] for b in word]
        left, right, heap = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1], []

        def offer(i: int, j: int) -> None:
            rank = get(parts[i] * size + parts[j])
            if rank is not None:
                heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, a, b = heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue  # a part has changed since
            parts[i], parts[j], right[i] = self.made[rank], -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """Packed ids of one word."""
        raw = word.encode("utf-8", "surrogatepass")
        return np.array(self.short(raw) if len(raw) <= SHORT_BYTES else self.long(raw), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Packed little-endian unsigned 32-bit ids of a text; strings of special tokens become their ids."""
        ids = self.cache
        if self.marks is None or not any(s in text for s in self.special):
            return b"".join([ids[w] for w in self.words(text)])
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [ids[w] for w in self.words(text[at : m.start()])]
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join([*out, *(ids[w] for w in self.words(text[at:]))])

    def decode(self, ids: bytes) -> str:
        """Text of packed ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Cache(dict):
    """Packed ids of the words seen, up to a bound; very long words are not kept."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> bytes:
        packed = self.pairs.word(word)
        if len(word) <= SHORT_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed


_loaded: dict[str, BytePairs] = {}


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """Send the vocabulary file (bounded by its size, some MB) to the executors, which need not see the driver's path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def byte_pairs(shared: Broadcast) -> BytePairs:
    """The vocabulary in a worker, parsed once."""
    hold("byte pairs", _loaded.clear)
    path, spec = shared.value
    if path not in _loaded:
        _loaded[path] = BytePairs(spec)
    return _loaded[path]


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def encode_documents(docs: DataFrame, vocabulary: str, decode: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), and the text decoded from them.

    A null text counts as empty: no ids, empty decoded text.  Other columns are not read.  Texts are encoded whole.  Rows are
    independent, so there is no shuffle; ``decode=False`` leaves ``decoded`` null.
    """
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(shared)
        for part in slices(batches):
            ids = [pairs.encode(t or "") for t in part.column("text").to_pylist()]
            texts = [pairs.decode(x) for x in ids] if decode else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return cols.mapInArrow(run, SCHEMA)


def decode_documents(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text of packed ``ids``; null ids give an empty text."""
    shared = share_vocabulary(rows.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(shared)
        for part in slices(batches, "ids"):
            texts = [pairs.decode(x or b"") for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
