"""Language identification by unigrams with the segmentation summed out.

Every language has a probability for each piece of a fixed public vocabulary.  A word's probability in a language is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words.  The piece
probabilities are fitted by expectation-maximisation on the words of all labelled documents: every round is a pass over the
distinct words, whose expected pieces are summed by Spark.  A worker scores a word once and keeps its vector, up to a bound.

The posterior among the learned languages is near 1 for almost every text, also for one in none of them.  Whether a text is in
its best language at all is told by its log probability per letter, against the median of labelled documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from starfold.core import quantiles, written
from starfold.llm.workers import SLICE_BYTES, hold, slices

ROUNDS = 2
UNIT = 1 << 24  # expected counts are summed in these fractions, as integers: the order of the words does not matter
SMOOTHING = 0.1
RUN_LETTERS = 40  # longer words are fitted and scored in runs of so many letters
EXCESS = 1.5  # a text's log probability per letter may lie so far below the median of its language
LEAST_LETTERS = 60  # texts with fewer letters are too short to be judged by it
CACHE_WORDS = 600_000
BLOCK_WORDS = 20_000  # new words that are scored together
BLOCK_RUNS = 4_096
START = "▁"  # fixed value: the vocabulary's mark of a word's start
LETTERS = r"\p{L}+"


def pieces_of(path: str) -> list[str]:
    """The pieces of a public sentence-piece vocabulary that are letters after an optional start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fits = regex.compile(rf"{START}?{LETTERS}|{START}").fullmatch
    return sorted({p for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and fits(p := model.id_to_piece(i).lower())})


def runs_of(word: str) -> list[str]:
    """A word behind its start mark, in runs of ``RUN_LETTERS``."""
    word = START + word
    return [word[at : at + RUN_LETTERS] for at in range(0, len(word), RUN_LETTERS)]


class Unigrams:
    """Piece probabilities: ``table`` maps a piece to one probability per language; single letters outside it have ``floor``."""

    def __init__(self, langs: list[str], table: dict[str, tuple[float, ...]], floor: tuple[float, ...]):
        self.langs, self.table, self.floor = langs, table, floor
        # every beginning of a piece, with the probabilities of whole pieces: a search ends where no piece goes on
        self.begins: dict[str, tuple[float, ...] | None] = {p[:k]: None for p in table for k in range(1, len(p))}
        self.begins.update(table)

    def cuts(self, word: str) -> list[tuple[int, int, tuple[float, ...], str]]:
        """(start, end, probabilities, piece) of every piece in ``word``; letters without a piece stand for themselves."""
        found, begins, n = [], self.begins, len(word)
        for i in range(n):
            if begins.get(word[i]) is None:
                found.append((i, i + 1, self.floor, word[i]))
            for j in range(i + 1, n + 1):
                piece = word[i:j]
                if piece not in begins:
                    break
                p = begins[piece]
                if p is not None:
                    found.append((i, j, p, piece))
        return found

    def score(self, word: str) -> list[float]:
        """Log probability of a lower-cased word per language."""
        return Forward(self).scores([word])[0].tolist()


class Forward:
    """The forward algorithm over many words at once: all runs of a block take one more letter of their pieces at a time."""

    def __init__(self, model: Unigrams):
        self.size, self.floor = len(model.langs), np.array(model.floor)
        self.letters = {c: k for k, c in enumerate(sorted({c for p in model.table for c in p}), 1)}  # 0 is any other letter
        number = {"": 0} | {p: k for k, p in enumerate(model.begins, 1)}
        span = self.span = len(self.letters) + 1
        steps = np.array([number[p[:-1]] * span + self.letters[p[-1]] for p in model.begins], np.int64)  # a beginning and its next letter
        order = np.argsort(steps)
        self.steps, self.ends = np.append(steps[order], np.iinfo(np.int64).max), np.append(order + 1, 0)
        whole = [model.begins[p] for p in model.begins]
        self.is_piece = np.array([False, *[p is not None for p in whole]])
        none = (0.0,) * self.size
        self.p = np.array([none, *[none if p is None else p for p in whole]])
        self.alone = np.array([True, *[model.begins.get(c) is None for c in self.letters]])  # letters without a piece of their own
        self.codes = np.array([*map(ord, self.letters), 1 << 32], np.int64)
        self.names, self.expected = list(model.begins), np.zeros(len(self.p) * self.size, np.int64)
        self.lone: dict[str, list[int]] = defaultdict(lambda: [0] * self.size)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probabilities of lower-cased words, one row per word and one column per language."""
        total = np.zeros((len(words), self.size))
        runs = [(k, run) for k, word in enumerate(words) for run in runs_of(word)]
        by_length = sorted(range(len(runs)), key=lambda r: len(runs[r][1]))
        logs = np.zeros((len(runs), self.size))
        for at in range(0, len(runs), BLOCK_RUNS):
            block = by_length[at : at + BLOCK_RUNS]
            x = self._sums([runs[r][1] for r in block])
            logs[block] = np.array([math.log(v if v > 1e-300 else 1e-300) for v in x.ravel().tolist()]).reshape(x.shape)
        np.add.at(total, [k for k, _ in runs], logs)  # the runs of a word in their order
        return total

    def _letters(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths of the runs; code points and letter numbers, one column per run."""
        lengths = np.array([len(r) for r in runs])
        longest = int(lengths.max())
        codes, letters = np.zeros((longest, len(runs)), np.int64), np.zeros((longest, len(runs)), np.int64)
        there = np.arange(longest) < lengths[:, None]
        flat = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        place = np.searchsorted(self.codes, flat)
        codes.T[there], letters.T[there] = flat, np.where(self.codes[place] == flat, place + 1, 0)
        return lengths, codes, letters

    def _moves(self, lengths: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(start, end, runs, their pieces) by start and end; None stands for letters without a piece of their own."""
        longest = len(letters)
        for i in range(longest):
            rows = np.flatnonzero(lengths > i)
            lone = rows[self.alone[letters[i, rows]]]
            if len(lone):
                yield i, i + 1, lone, None
            state = np.zeros(len(rows), np.int64)
            for j in range(i, longest):
                step = state * self.span + letters[j, rows]
                place = np.searchsorted(self.steps, step)
                goes_on = self.steps[place] == step
                rows, state = rows[goes_on], self.ends[place[goes_on]]
                if not len(rows):
                    break
                whole = self.is_piece[state]
                yield i, j + 1, rows[whole], state[whole]

    def _sums(self, runs: list[str]) -> np.ndarray:
        """Summed probability of all cuts of each run per language."""
        lengths, _, letters = self._letters(runs)
        out = np.zeros((len(letters) + 1, len(runs), self.size))
        out[0] = 1.0
        for i, j, rows, pieces in self._moves(lengths, letters):
            out[j, rows] += out[i, rows] * (self.floor if pieces is None else self.p[pieces])
        return out[lengths, np.arange(len(runs))]

    def expect(self, words: list[str], langs: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``expected`` and ``lone`` what ``expected_pieces`` finds for words that a language has so many times."""
        runs = [(run, k) for k, word in enumerate(words) for run in runs_of(word)]
        runs.sort(key=lambda r: len(r[0]))
        for at in range(0, len(runs), BLOCK_RUNS):
            block = runs[at : at + BLOCK_RUNS]
            of = np.array([k for _, k in block])
            self._expect([run for run, _ in block], langs[of], counts[of])

    def _expect(self, runs: list[str], lang: np.ndarray, n: np.ndarray) -> None:
        lengths, codes, letters = self._letters(runs)
        every = np.arange(len(runs))
        ahead, back = np.zeros((2, len(letters) + 1, len(runs)))
        ahead[0], back[lengths, every] = 1.0, 1.0
        moves = []
        for i, j, rows, pieces in self._moves(lengths, letters):
            p = self.floor[lang[rows]] if pieces is None else self.p[pieces, lang[rows]]
            ahead[j, rows] += ahead[i, rows] * p
            moves.append((i, j, rows, pieces, p))
        whole = ahead[lengths, every]
        share = np.divide(UNIT * n, whole, out=np.zeros(len(runs)), where=whole > 1e-290)  # 0: too improbable for a double
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j, rows, pieces, p in reversed(moves):
            x = p * back[j, rows]
            back[i, rows] += x
            parts = np.rint(ahead[i, rows] * x * share[rows]).astype(np.int64)
            if pieces is None:
                for c, k, part in zip(codes[i, rows].tolist(), lang[rows].tolist(), parts.tolist(), strict=True):
                    self.lone[chr(c)][k] += part
            else:
                found.append((pieces * self.size + lang[rows], parts))
        if found:
            np.add.at(self.expected, np.concatenate([at for at, _ in found]), np.concatenate([parts for _, parts in found]))

    def expected_parts(self) -> tuple[list[str], list[list[int]]]:
        """Pieces and lone letters with their expected counts per language so far, in parts of 1 / ``UNIT``."""
        table = self.expected.reshape(-1, self.size)
        at = np.flatnonzero(table.any(axis=1))
        return [self.names[k - 1] for k in at.tolist()] + list(self.lone), table[at].tolist() + list(self.lone.values())


def started(langs: list[str], pieces: list[str]) -> Unigrams:
    """The model before the first round: equal probabilities in all languages, which fall with length."""
    return Unigrams(langs, {p: (10.0 ** -(2 + len(p.removeprefix(START)) / 2),) * len(langs) for p in pieces}, (1e-6,) * len(langs))


def expected_pieces(model: Unigrams, word: str, counts: dict[int, int], out: dict[str, list[int]]) -> None:
    """Add to ``out`` how often each piece is expected in a word that each language has so many times, in parts of 1 / ``UNIT``."""
    for run in runs_of(word):
        cuts = model.cuts(run)
        for k, n in counts.items():  # only the languages that have the word
            ahead, back = [1.0, *[0.0] * len(run)], [*[0.0] * len(run), 1.0]
            for i, j, p, _ in cuts:
                ahead[j] += ahead[i] * p[k]
            if ahead[-1] <= 0:
                continue
            share = UNIT * n / ahead[-1]
            for i, j, p, piece in reversed(cuts):
                x = p[k] * back[j]
                back[i] += x
                out[piece][k] += round(ahead[i] * x * share)


def improved(model: Unigrams, pieces: list[str], expected: dict[str, list[int]]) -> Unigrams:
    """The model with probabilities by expected counts."""
    size = range(len(model.langs))
    sums = [SMOOTHING * len(pieces) + sum(e[k] for e in expected.values()) / UNIT for k in size]
    none = [0] * len(model.langs)
    table = {p: tuple((expected.get(p, none)[k] / UNIT + SMOOTHING) / sums[k] for k in size) for p in sorted({*pieces, *expected})}
    return Unigrams(model.langs, table, tuple(SMOOTHING / x for x in sums))


def fit_unigrams(langs: list[str], counts: dict[tuple[str, str], int], pieces: list[str], rounds: int = ROUNDS) -> Unigrams:
    """Fit by expectation-maximisation on ``counts`` of (language, word)."""
    model = started(langs, pieces)
    for _ in range(rounds):
        expected: dict[str, list[int]] = defaultdict(lambda: [0] * len(langs))
        for (lang, word), n in counts.items():
            expected_pieces(model, word, {langs.index(lang): n}, expected)
        model = improved(model, pieces, expected)
    return model


def expected_over(words: DataFrame, model: Unigrams) -> dict[str, list[int]]:
    """Expected pieces over all ``words`` (w, seen: array of (lang, n)): one row per piece of a partition, summed by Spark."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language fit")
        forward, langs = Forward(shared.value), pa.array(shared.value.langs, pa.string())
        for part in batches:
            seen = part.column("seen")
            lang, n = (pc.struct_field(seen.flatten(), k) for k in ("lang", "n"))
            words = part.column("w").take(pc.list_parent_indices(seen)).to_pylist()
            forward.expect(words, pc.index_in(lang, langs).to_numpy(), n.to_numpy())
        pieces, parts = forward.expected_parts()
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(parts, pa.list_(pa.int64()))], ["piece", "parts"])

    parts = words.mapInArrow(run, "piece string, parts array<bigint>").select("piece", F.posexplode("parts").alias("k", "n")).where("n > 0")
    found: dict[str, list[int]] = defaultdict(lambda: [0] * len(model.langs))
    for r in parts.groupBy("piece", "k").agg(F.sum("n").alias("n")).collect():  # the size of the model: pieces and letters times languages
        found[r["piece"]][r["k"]] = r["n"]
    return found


def train(labelled: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> Unigrams:
    """Fit on ``labelled`` (doc_id, text, lang): all words of all documents with a text and a language."""
    rows = labelled.where("lang is not null and text is not null")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))
    counts = rows.select("lang", F.explode(tokens).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    words = written(counts.groupBy("w").agg(F.collect_list(F.struct("lang", "n")).alias("seen")))
    langs = sorted(r[0] for r in words.select(F.explode("seen.lang").alias("lang")).distinct().collect())  # one row per language
    pieces = pieces_of(vocabulary)
    model = started(langs, pieces)
    for _ in range(rounds if langs else 0):
        model = improved(model, pieces, expected_over(words, model))
    return model


class Numbers(dict):
    """A number for every word, in the order in which they come; ``fresh`` are those since it was emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Scorer:
    """Scores of texts in a worker, with the vectors of the words seen, up to a bound."""

    def __init__(self, model: Unigrams):
        self.langs, self.forward, self.find = model.langs, Forward(model), regex.compile(LETTERS).findall
        self.clear()

    def clear(self) -> None:
        self.row = Numbers()
        self.vectors = np.zeros((1024, len(self.langs)))
        self.sizes = np.zeros(1024, np.int64)

    def add(self, words: list[str]) -> None:
        """Score new words, the last ones that got a number."""
        start, end = len(self.row) - len(words), len(self.row)
        if end > len(self.vectors):
            more = max(end, 2 * len(self.vectors)) - len(self.vectors)
            self.vectors = np.concatenate([self.vectors, np.zeros((more, len(self.langs)))])
            self.sizes = np.concatenate([self.sizes, np.zeros(more, np.int64)])
        self.sizes[start:end] = list(map(len, words))
        for at in range(0, len(words), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS]
            self.vectors[start + at : start + at + len(part)] = self.forward.scores(part)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """Per text its language, its probability, the text's log probability in it per letter, and the letters; ``und`` and 0 without a letter or without a language to choose from."""
        if len(self.row) > CACHE_WORDS:
            self.clear()
        get, rows = self.row.__getitem__, []
        for t in texts:
            words = self.find(t.lower()) if t and self.langs else []
            rows.append(np.fromiter(map(get, words), np.int64, len(words)))
        self.add(self.row.fresh)
        self.row.fresh = []
        return [self._best(at) if len(at) else ("und", 0.0, 0.0, 0) for at in rows]

    def _best(self, rows: np.ndarray) -> tuple[str, float, float, int]:
        total = np.zeros(len(self.langs))
        for at in range(0, len(rows), 50_000):
            total += self.vectors[rows[at : at + 50_000]].sum(axis=0)
        best, letters = int(total.argmax()), int(self.sizes[rows].sum())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum()), float(total[best]) / letters, letters


_scorers: dict[int, Scorer] = {}


def scorer(shared: Broadcast) -> Scorer:
    """The scorer of a shared model in a worker."""
    hold("language scores", _scorers.clear)
    model = shared.value
    if id(model) not in _scorers:
        _scorers.clear()
        _scorers[id(model)] = Scorer(model)
    return _scorers[id(model)]


FOUND = ["__lang_pred", "__score", "__per_letter", "__letters"]


def identify(docs: DataFrame, model: Unigrams) -> DataFrame:
    """``docs`` with ``__lang_pred`` and ``__score``: the language by ``text`` alone, from the model's languages; and with
    ``__per_letter`` and ``__letters``: the text's log probability in it per letter, and its letters.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when the model has no language.  Equal
    scores go to the first language by code point.  Rows are independent: no shuffle.  The model's size is that of the
    vocabulary times the languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared)
        for part in slices(batches, limit=SLICE_BYTES // 4):  # a slice's words are held together
            found = score.predict(part.column("text").to_pylist())
            added = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *FOUND])

    kinds = (StringType(), DoubleType(), DoubleType(), LongType())
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *map(StructField, FOUND, kinds)]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def own_documents(docs: DataFrame) -> DataFrame:
    """The documents with an id that are not held out."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return own.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def learned(docs: DataFrame, vocabulary: str) -> Unigrams:
    """Model from the documents with an id that are not held out."""
    return train(own_documents(docs), vocabulary)


def least_per_letter(found: DataFrame, excess: float = EXCESS) -> dict[str, float]:
    """Least log probability per letter of each language, from all rows of ``found`` (identified documents) that may be learned from.

    The bound lies ``excess`` below the median of the documents that are recognised, which a minority of odd documents under a
    label does not move.  The median is picked from ranks.  Languages of which no document is recognised have no bound.
    """
    own = found.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.col("__lang_pred") == F.col("lang").cast("string")) & (F.col("__letters") >= LEAST_LETTERS))
    mid = quantiles(own.select("__lang_pred", "__per_letter"), "__lang_pred", "__per_letter", {"mid": 0.5})
    return {r["__lang_pred"]: r["mid"] - excess for r in mid.collect()}  # one row per language


def in_known_language(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows.

    A text needs a score of at least ``least`` among the languages, and a log probability per letter that documents of its
    language have: texts in other languages and random letters go.  Texts below ``LEAST_LETTERS`` letters are judged by the score
    alone.  Null texts and texts without a letter go.
    """
    found = written(identify(docs, learned(docs, vocabulary)))  # scored once: for the bounds and for the choice
    bound = F.lit(None).cast("double")
    for lang, x in least_per_letter(found).items():
        bound = F.when(F.col("__lang_pred") == lang, F.lit(x)).otherwise(bound)
    usual = (F.col("__letters") < LEAST_LETTERS) | F.coalesce(F.col("__per_letter") >= bound, F.lit(True))
    return found.where((F.col("__lang_pred") != "und") & (F.col("__score") >= least) & usual).select(*docs.columns)
