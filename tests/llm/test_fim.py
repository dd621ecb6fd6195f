"""Fill-in-middle against a plain walk over tokens."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from starfold.llm import fim

SPACE = " \t\n\x0b\x0c\r"


def plain_walk(doc_id, text, rate=50, spm=80):
    """Tokens found one after the other, without the library's pattern."""
    tokens, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in SPACE:
            end += 1
        while end < len(text) and text[end] not in SPACE:
            end += 1
        tokens.append(text[at:end])
        at = end
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm_form = h[3] % 100 < spm
    return n, "spm" if spm_form else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    pieces = ["a", "é", "😀", " ", "\n", "\t", "\x0b", "\x0c\r", "\u00a0", "\u2003", "\x1c", "\x85", "<", "<P", ">", "S>", "<S><", "<M>", "word"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(30))) for _ in range(300)]
    return [None, "", " ", "\n \t", "x", "x ", "\u00a0x", "<P", "a<S", *made, "long text " * 60_000, " " * 200_000]


def test_equals_a_plain_walk_and_restores(spark):
    rows = [*enumerate(texts()), (None, "a b c"), (7, "twice here"), (7, "twice here"), (-5, "minus five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("mine")).withColumn("n", F.lit("clash"))
    cut = fim.fill_in_middle(docs, rate=90)
    got = cut.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[-1])
    want = sorted(((d, *plain_walk(d, t or "", 90), t or "") for d, t in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_rerun(spark):
    docs = spark.createDataFrame([(i, f"some words {i} here") for i in range(50)], "doc_id long, text string")
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    assert sorted(fim.fill_in_middle(docs.repartition(7)).collect()) == sorted(fim.fill_in_middle(docs).collect())
