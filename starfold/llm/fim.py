"""Fill-in-middle transformation: a text is cut at two token ends and its parts are put in a new order behind sentinels.

Tokens are words with the white space before them, and white space at the end.  One ``fullmatch`` of the repeated token
group keeps every repetition, so ``ends(1)`` of the match holds all token ends: its length is the number of tokens and the
two cut offsets are looked up in it.  The group and its parts are possessive: no repetition is ever tried anew, so time and
memory are linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm.workers import slices

# A token, and the sentinels before prefix, suffix and middle.
TOKEN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

RATE, SPM, SEED = 50, 80, 42

_tokens = regex.compile(f"({TOKEN})*+")


def cut(text: str, draws: list[int], rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix length, middle length, output) of one text; ``draws`` are four unsigned numbers."""
    ends = _tokens.fullmatch(text).ends(1)
    n = len(ends)
    if not n or draws[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form (plain, spm, psm), prefix_chars, middle_chars, output (the text).

    ``rate`` percent of the documents are cut, ``spm`` percent of these put the suffix first.  Draws are the first four
    8-digit groups of sha256 of ``seed:doc_id``, so reruns and other partitionings agree and repeated rows of a document are
    cut alike; a null id draws as an empty one.  Null texts are empty; empty texts and texts that hold a sentinel stay plain.
    Whole texts are cut, of any length.  Columns other than doc_id and text are not read, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            digests = part.column("draws").to_pylist()
            rows = [cut(t, [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)], rate, spm) for t, d in zip(part.column("text").to_pylist(), digests, strict=True)]
            columns = [list(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    number = F.col("doc_id").cast("long")
    draws = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(number.cast("string"), F.lit(""))).cast("binary"), 256)
    given = docs.select(number.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), draws.alias("draws"))
    return given.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    A text that was cut holds no sentinel, and no sentinel can arise at a seam, so cutting at the three sentinels gives the parts.
    """
    parts = F.split(output, "<[PSM]>", -1)
    ordered = lambda *at: F.concat(*[F.element_at(parts, k) for k in at])
    return F.when(form == "spm", ordered(3, 4, 2)).when(form == "psm", ordered(2, 4, 3)).otherwise(output)
