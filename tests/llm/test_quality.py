"""Quality rules against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from starfold.llm import quality

WORDS = ["the", "of", "and", "house", "river", "green", "walks", "stone", "light", "over", "To", "IS"]


def corpus():
    rng = random.Random(2)
    good = [" ".join(rng.choices(WORDS, k=rng.randint(40, 160))).replace("stone", "stone.\n") for _ in range(60)]
    marks = [" ".join(w + "&&&" if i % 2 else w + "$$$" for i, w in enumerate(rng.choices(WORDS[3:10], k=120))) for _ in range(3)]
    again = ["one two three four five six seven eight nine ten " * 6, "a b c d e f g h " + " ".join(map(str, range(30))) + " a b c d e f g h"]
    odd = [None, "", " \n\x0b ", "short text", "line\nline\n\n \nline", "x " * 20_000, " ".join(f"plain{i}" for i in range(70)), "\x85word other\u3000third " * 3]
    rows = [(i, t, "en") for i, t in enumerate([*good, *marks, *again, *odd])]
    return [*rows, (None, good[0], None), (1, good[1], "en"), (900, good[2], "xx")]


def base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
    return math.sqrt(max(0.0, sum(part(p.get(k, 0), q.get(k, 0)) + part(q.get(k, 0), p.get(k, 0)) for k in {*p, *q}) / 2))


def words_of(text):
    c = Counter(w if (w := x.decode().lower()) in quality.COMMON else "" for x in text.encode().split())
    return c


def shares(c):
    n = sum(c.values())
    return {k: v / n for k, v in c.items()}


def test_counts_distances_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, lang string, kept string")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    key = lambda d, b: (-1 if d is None else d, *b)
    have = sorted((key(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])), r["base_failed"], r["kept"], r["word_distance"]) for r in got)
    want = sorted(key(d, base(t)) for d, t, _ in rows)
    assert [h[0] for h in have] == want
    for (_, n, _, _, _, again), failed, kept, _ in have:
        assert failed == (n < 20 or 100 * again > 30 * n)
        assert not (failed and kept)
    ref = Counter()
    for _, t, lang in rows:
        n, _, symbols, _, again = base(t)
        if lang == "en" and not (n < 20 or 100 * again > 30 * n) and 20 * symbols <= n:
            ref += words_of(t)
    by_id = {r["doc_id"]: r for r in got}
    for d, t, lang in rows:
        r = by_id[d]
        if lang == "en" and r["n_words"] >= quality.GUARD_WORDS:
            assert abs(r["word_distance"] - js(shares(words_of(t)), shares(ref))) < 1e-6
        elif r["n_words"] < quality.GUARD_WORDS:
            assert r["word_distance"] is None
    assert all(by_id[i]["kept"] for i in range(60) if not by_id[i]["base_failed"])
    assert not any(by_id[i]["kept"] for i in (60, 61, 62))


def test_stage_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").selectExpr("*", "'x' AS classes", "1 AS n_words")
    out = quality.good_documents(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(1) == 2 and None in kept and 60 not in kept and 67 not in kept
    assert quality.quality(docs.where("false")).count() == 0


def test_unlabelled_text_of_a_small_language_is_judged_by_its_nearest_reference(spark):
    rng = random.Random(5)
    words = {"en": ["the", "of", "and", "in", "house", "river", "green", "stone"], "fr": ["le", "de", "et", "que", "maison", "rivière", "élève", "forêt"]}
    write = lambda lang: " ".join(rng.choices(words[lang], k=150)) + "."
    rows = [(i, write("en"), "en") for i in range(200)] + [(200 + i, write("fr"), "fr") for i in range(20)]
    rows += [(300 + i, write("fr"), None) for i in range(5)] + [(310, write("fr"), "rare"), (311, write("en"), None)]
    rows += [(320, " ".join(f"{w}{i}" for i, w in enumerate(rng.choices(["maison", "forêt"], k=150))), None)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[d]["kept"] for d in (*range(220), *range(300, 305), 310, 311)) and not got[320]["kept"]
    refs = {lang: sum((words_of(t) for _, t, x in rows if x == lang), Counter()) for lang in words}
    for d in (300, 310, 311):
        want = min(js(shares(words_of(rows_text)), shares(ref)) for ref in refs.values() for i, rows_text, _ in rows if i == d)
        assert abs(got[d]["word_distance"] - want) < 1e-6
    alone = quality.quality(spark.createDataFrame([(i, t, None) for i, t, x in rows if x == "en"], "doc_id long, text string, lang string")).collect()
    assert all(r["kept"] and r["word_distance"] is not None for r in alone)  # no language has a reference: all together


def test_good_documents_keep_rows_and_clashing_columns(spark):
    text = "The house stands in the old garden and a small river runs to the stone bridge, where people of our town walk on every morning with their dogs."
    rows = [(1, text, "en", 5, "a"), (1, text, "en", 5, "a"), (1, text + "&$%#" * 40, "en", 6, "b"), (None, text, None, None, None), (2, None, "en", 7, "c"), (3, "short", None, 8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int, kept string")
    want = {(r["doc_id"], r["text_hash"]) for r in quality.quality(docs).where("kept").collect()}
    got = quality.good_documents(docs)
    assert got.schema == docs.schema
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r)[:-1]) for r in hashed if (r["doc_id"], r["h"]) in want)
    assert want and len(want) < len({(r["doc_id"], r["h"]) for r in hashed})
