"""Language identification."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import langid
from starfold.llm.common import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
WORDS = {"aa": ["lorel", "miran", "sola", "tendo", "varim"], "bb": ["krust", "schlag", "wurz", "bricht", "stolz"]}


def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=30)), lang, "x") for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    rows += [(100, None, "aa", None), (101, "123 !?", "bb", None), (102, "", None, None), (None, "krust wurz", None, None), (103, "sola " * 30_000, None, "y"), (1, rows[1][1], "bb", "x"), (104, "²½_ 9", "aa", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, __lang string")


def test_predictions(spark):
    rows, df = docs(spark)
    got = langid.identify(df.select("doc_id", "text"), langid.learned(df, PATH)).collect()
    assert len(got) == len(rows)
    want = {(d, t): lang for d, t, lang, _ in rows}
    for r in got:
        assert 0 <= r["__score"] <= 1
        if r["doc_id"] in (100, 101, 102, 104):
            assert (r["__lang_pred"], r["__score"]) == ("und", 0.0)
        else:
            assert r["__lang_pred"] == (want[r["doc_id"], r["text"]] or ("aa" if r["doc_id"] == 103 else "bb"))
    kept = langid.in_known_language(df, PATH)
    assert kept.columns == df.columns and kept.count() == len(rows) - 4


def test_without_labels_or_rows(spark):
    _, df = docs(spark)
    none = langid.learned(df.where("lang is null"), PATH)
    assert {r["__lang_pred"] for r in langid.identify(df.select("text"), none).collect()} == {"und"}
    assert langid.in_known_language(df.where("false"), PATH).count() == 0


def test_held_out_text_does_not_train(spark):
    _, df = docs(spark)
    held = df.where(langid.held_out(df["doc_id"]))
    assert held.count() and langid.learned(held, PATH).langs == []


def test_forward_sums_all_segmentations():
    model = langid.Unigrams(["x", "y"], {"a": (0.5, 0.1), "b": (0.2, 0.3), "ab": (0.1, 0.6), "aba": (0.05, 0.0), langid.START: (1.0, 1.0)}, (1e-6, 1e-6))

    def total(word, k):
        return 1.0 if not word else sum(model.table[word[:n]][k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in model.table)

    for word in ("ab", "abab", "aabba"):
        assert model.score(word) == pytest.approx([math.log(total(word, 0)), math.log(total(word, 1))])
    assert all(math.isfinite(x) for x in model.score("z" * 500))


def test_words_are_scored_together_as_one_by_one(monkeypatch):
    rng = random.Random(5)
    pieces = [langid.START, *"abc", *{"".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(60)}]
    model = langid.Unigrams(["x", "y"], {p: (rng.random() / 9, rng.random() / 9) for p in pieces}, (1e-6, 1e-7))

    def plain(word):
        total = [0.0, 0.0]
        for run in langid.runs_of(word):
            ahead = [[1.0, 1.0], *[[0.0, 0.0] for _ in run]]
            for i, j, p, _ in model.cuts(run):
                ahead[j] = [b + a * x for b, a, x in zip(ahead[j], ahead[i], p, strict=True)]
            total = [t + math.log(max(x, 1e-300)) for t, x in zip(total, ahead[-1], strict=True)]
        return total

    words = list({"".join(rng.choices("abcdez", k=rng.choice([1, 2, 5, 9, 39, 40, 85]))) for _ in range(300)})
    monkeypatch.setattr(langid, "BLOCK_RUNS", 70)
    assert langid.Forward(model).scores(words).tolist() == [plain(w) for w in words]
    monkeypatch.setattr(langid, "BLOCK_WORDS", 50)
    scorer, scored = langid.Scorer(model), []
    whole = scorer.forward.scores
    monkeypatch.setattr(scorer.forward, "scores", lambda part: scored.extend(part) or whole(part))
    texts = [" ".join(words), None, "1 2", " ".join(words[::-1])]
    found = scorer.predict(texts)
    assert sorted(scored) == sorted(words) and found[1] == found[2] == ("und", 0.0, 0.0, 0) and found[0][0] == found[3][0] and found[0][3] == sum(map(len, words))


def test_every_run_of_a_long_word_is_learned():
    word = "ab" * 60 + "q" * 30
    model = langid.fit_unigrams(["x"], {("x", word): 5}, [langid.START, "ab", "q", "z"])
    assert "".join(langid.runs_of(word)) == langid.START + word
    assert model.table["q"][0] > 10 * model.table["z"][0]


def test_texts_in_no_learned_language_go(spark):
    rng = random.Random(4)
    _, df = docs(spark)
    noise = [(1000 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(30)), None, "n") for i in range(50)]
    clean = [(2000 + i, " ".join(rng.choices(WORDS["aa"], k=30)), None, "n") for i in range(50)]
    short = [(3000, "qxv zzk", None, "n")]  # below the letters that tell
    both = df.unionByName(spark.createDataFrame(noise + clean + short, df.schema))
    kept = {r["doc_id"] for r in langid.in_known_language(both, PATH).where("doc_id >= 1000").collect()}
    assert kept - {3000} == {2000 + i for i in range(50)}
    found = langid.identify(both.where("doc_id between 1000 and 1999"), langid.learned(df, PATH)).collect()
    assert all(r["__score"] > 0.5 for r in found)  # the posterior alone keeps them


def test_every_labelled_document_is_learned_from(spark):
    rows = [(i, "sola miran " * 20, "aa") for i in range(400)] + [(1000 + i, "sola " * 19 + "".join(chr(97 + i // 26 ** k % 26) for k in range(4)) + "zzq", "aa") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, PATH)
    counts = {}
    for _, text, lang in rows:
        for w in text.split():
            counts[lang, w] = counts.get((lang, w), 0) + 1
    alone = langid.fit_unigrams(["aa"], counts, langid.pieces_of(PATH))
    assert model.table == alone.table and model.floor == alone.floor
    found = langid.identify(df, model)
    per = sorted(r["__per_letter"] for r in found.where(~langid.held_out(F.col("doc_id"))).collect())
    mid = (per[(len(per) - 1) // 2] + per[len(per) // 2]) / 2
    assert langid.least_per_letter(found)["aa"] == pytest.approx(mid - langid.EXCESS, abs=1e-12)


def test_expected_pieces_of_many_words_equal_those_one_by_one():
    rng = random.Random(3)
    langs = ["aa", "bb", "cc"]
    model = langid.started(langs, ["▁", "▁a", "ab", "b", "abc", "cab", "▁abca", "d"])
    words = ["".join(rng.choices("abcdé𝒳", k=rng.randint(1, 12))) for _ in range(300)] + ["abc" * 70, "é" * 200]
    seen = [{k: rng.randint(1, 9) for k in rng.sample(range(3), rng.randint(1, 3))} for _ in words]
    for _ in range(2):
        want = defaultdict(lambda: [0] * len(langs))
        for w, n in zip(words, seen, strict=True):
            langid.expected_pieces(model, w, n, want)
        forward = langid.Forward(model)
        pairs = [(w, k, c) for w, n in zip(words, seen, strict=True) for k, c in n.items()]
        for part in (pairs[:100], pairs[100:]):
            forward.expect([w for w, _, _ in part], np.array([k for _, k, _ in part]), np.array([c for _, _, c in part]))
        assert dict(zip(*forward.expected_parts(), strict=True)) == {p: n for p, n in want.items() if any(n)}
        model = langid.improved(model, list(model.table), want)


def test_predictions_look_each_word_up_once():
    model = langid.started(["aa", "bb"], ["▁", "a", "b"])
    scorer, asked = langid.Scorer(model), []

    class Counted(langid.Numbers):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    scorer.row = Counted()
    found = scorer.predict(["ab ba ab", None, "ab c"])
    assert asked == ["ab", "ba", "ab", "ab", "c"] and [x[3] for x in found] == [6, 0, 3]
    assert found == langid.Scorer(model).predict(["ab ba ab", None, "ab c"])
