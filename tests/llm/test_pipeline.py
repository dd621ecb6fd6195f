"""The corpus pipeline against plain Python on a small corpus."""

import hashlib
import random
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from starfold.llm.common import vocabulary
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import targets

WORDS = {"en": "the of and house river green walks stone light over water bridge morning letter".split(), "de": "der die und das haus fluss wald stein licht brief wasser strasse morgen garten".split()}


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append([i, " ".join(rng.choices(WORDS[lang], k=rng.randint(40, 90))), lang, f"s{i % 4}"])
    for i in range(60, 90):  # near copies and copies of copies
        _, text, lang, source = rows[rng.randrange(len(rows))]
        words = text.split()
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), lang, source])
    bad = [None, "", "too short", "again and again " * 40, " ".join(w + "&&&" + "$$$" for w in rng.choices(WORDS["en"], k=80)), "1234 5678 " * 3]
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(40)) for _ in range(3)]  # in no language
    return rows + [[90 + i, t, "en", "s0"] for i, t in enumerate(bad)] + [[100 + i, t, None, "s0"] for i, t in enumerate(noise)]


def test_run(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in rows}
    clean = [(r[0], r[1]) for r in rows if r[0] < 90]
    component = {d: c for d, _, c in brute(clean, 5, 80)}
    ids = Counter(r["doc_id"] for r in got)
    assert set(ids) <= set(component) and max(ids.values()) <= 2
    assert max(Counter(component[d] for d in ids).values()) == 1
    size, source = {d: len(t.split()) for d, t in clean}, {r[0]: r[3] for r in rows}
    heads = {c: [d for d in component if component[d] == c] for c in set(component.values())}
    assert all(len({source[d] for d in m}) == 1 for m in heads.values())
    sizes, most = Counter(), max(size.values())
    for c, members in heads.items():
        sizes[source[c]] += size[members[0]]  # copies have as many words
    want = targets(sizes)
    taken = Counter()
    for d, n in ids.items():
        taken[source[d]] += n * size[d]
    for s in want:
        assert abs(taken[s] - want[s]) <= most, s
    public = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for r in got:
        tokens = public.encode(text[r["doc_id"]], add_special_tokens=False).ids
        packed = b"".join(t.to_bytes(4, "little") for t in tokens)
        assert (r["n_tokens"], bytes(r["ids"])) == (len(tokens), packed)
        assert r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_language_stage_rejects_random_letters(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    good = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    known = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert {100, 101, 102} <= good and known & good == set(range(90))


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in corpus()], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
