"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves are runs of whole pre-tokens with their characters and tokens,
inner nodes are sums.  An edit re-encodes the leaves that it touches plus a boundary context: it starts at the last leaf
start that the edit cannot reach back to, and stops at the first pre-token boundary behind the edit that is also an old leaf
boundary.  From there on the pattern sees the same text as before, since it never looks back.  Sums on the way up follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from starfold.llm.bpe import BytePairs, byte_pairs, share_vocabulary
from starfold.llm.workers import slices

LEAF_CHARS = 256  # least characters of a leaf, but for the last
LONG_LEAF = 4 * LEAF_CHARS  # most characters of a leaf of several words; above, the tree gets new leaves
AHEAD = 2  # characters behind a pre-token that its match may depend on

# What the registered query redacts, and by what.
REDACTIONS = {r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+": "<email>", r"\b\d{1,3}(?:\.\d{1,3}){3}\b": "<address>"}


class TokenTree:
    """Token count of a text under edits."""

    def __init__(self, text: str, pairs: BytePairs, leaves: tuple[list[int], list[int]] | None = None):
        """``leaves`` are kept characters and tokens per leaf, so that nothing is encoded anew."""
        self.text, self.pairs = text, pairs
        self.reach = AHEAD + max([0, *map(len, pairs.special)])
        self.build(*(leaves or self.encoded(0, set())[:2]))

    def build(self, chars: list[int], tokens: list[int]) -> None:
        """Sums over the leaves: node ``k`` has children ``2k`` and ``2k + 1``."""
        self.leaves = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.leaves - len(chars))
        self.chars, self.tokens = ([0] * self.leaves + x + pad for x in (list(chars), list(tokens)))
        for k in range(self.leaves - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def count(self) -> int:
        """Tokens of the whole text."""
        return self.tokens[1]

    @property
    def state(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves, to keep."""
        own = [k for k in range(self.leaves, 2 * self.leaves) if self.chars[k]]
        return [self.chars[k] for k in own], [self.tokens[k] for k in own]

    def words(self, at: int) -> Iterator[tuple[int, int]]:
        """(end, tokens) of the pre-tokens from a boundary on."""
        pairs, text, cache = self.pairs, self.text, self.pairs.cache
        while at < len(text):
            mark = pairs.marks.search(text, at) if pairs.marks else None
            for m in pairs.pattern.finditer(text, at, mark.start() if mark else len(text)):
                yield m.end(), len(cache[m[0]]) // 4
            if mark is None:
                return
            yield mark.end(), 1
            at = mark.end()

    def encoded(self, at: int, stops: set[int]) -> tuple[list[int], list[int], int]:
        """New leaves from a boundary to the first boundary in ``stops`` or the end: characters, tokens, and where it ended."""
        chars, tokens, start, total = [], [], at, 0
        for end, n in self.words(at):
            total += n
            if end in stops or end - start >= LEAF_CHARS:
                chars.append(end - start)
                tokens.append(total)
                start, total = end, 0
            if end in stops:
                return chars, tokens, end
        if start < len(self.text):
            chars.append(len(self.text) - start)
            tokens.append(total)
        return chars, tokens, len(self.text)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's start."""
        k, before = 1, 0
        while k < self.leaves:
            k *= 2
            if place >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k, before

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace characters ``[start, end)``; returns how many characters were encoded again."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("edit outside of the text")
        first, at = self.leaf_at(max(0, start - self.reach))
        last, before = self.leaf_at(max(start, end - 1))
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        stops, old, k, place = {}, len(self.text) - shift, last, before
        while place < old and len(stops) < 8:  # some leaf ends behind the edit; if all are passed, encoding goes on to the end of the text
            place += self.chars[k]
            if place >= end:
                stops[place + shift] = k
            k += 1
        chars, tokens, stop = self.encoded(at, set(stops))
        final = stops.get(stop, 2 * self.leaves - 1)
        room = final - first + 1
        if len(chars) > room and sum(chars[room - 1 :]) > LONG_LEAF:  # no leaf to spare: leaves are laid out anew, nothing more is encoded
            n = self.leaves
            sides = [[(self.chars[k], self.tokens[k]) for k in ks if self.chars[k]] for ks in (range(n, first), range(final + 1, 2 * n))]
            kept = [*sides[0], *zip(chars, tokens, strict=True), *sides[1]]
            self.build([c for c, _ in kept], [t for _, t in kept])
            return stop - at
        if len(chars) > room:  # a little too much: the last leaf takes the rest
            chars[room - 1 :], tokens[room - 1 :] = [sum(chars[room - 1 :])], [sum(tokens[room - 1 :])]
        pad = [0] * (room - len(chars))
        self.chars[first : final + 1], self.tokens[first : final + 1] = chars + pad, tokens + pad
        lo, hi = first // 2, final // 2
        while lo:
            for k in range(lo, hi + 1):
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            lo, hi = lo // 2, hi // 2
        return stop - at


SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits long, edited_tokens long, recoded_chars long, edited string, leaf_chars array<int>, leaf_tokens array<int>"
Edits = Callable[[str], list[tuple[int, int, str]]]


def redactions(text: str, rules: dict[str, str] | None = None) -> list[tuple[int, int, str]]:
    """Edits that replace personal data; overlaps go to the earlier start."""
    found = sorted((m.start(), m.end(), new) for p, new in (rules or REDACTIONS).items() for m in regex.finditer(p, text))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def count_with_edits(docs: DataFrame, vocabulary: str, edits: Edits = redactions) -> DataFrame:
    """One row per document: its tokens, and its tokens after the ``edits`` of its text, by updates of its tree.

    ``edits`` gives (start, end, replacement) of a text in ascending order without overlap; they are applied from the last to the
    first, so no place shifts.  ``leaf_chars`` and ``leaf_tokens`` are the tree's leaves after the edits: keep them with the edited text
    and pass them to ``TokenTree`` to go on.  A null text is empty and has no leaves.  Rows are independent: no shuffle.
    """
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(shared)
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                text = text or ""
                tree, changes = TokenTree(text, pairs), edits(text)
                before, recoded = tree.count, 0
                for start, end, new in reversed(changes):
                    recoded += tree.replace(start, end, new)
                rows.append((doc, len(text), before, len(changes), tree.count, recoded, tree.text, *tree.state))
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
