"""Line deduplication against a plain version."""

import random

from pyspark.sql import functions as F

from starfold.llm import lines


def plain(rows, min_chars=10, min_docs=2):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(d)
    first = {k: min((d for d in h if d is not None), default=None) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for d, t in rows:
        given = (t or "").split("\n")
        kept = [x for x in given if key(x) not in first or first[key(x)] == d]
        out.append((d, len(given), len(given) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(docs, **options):
    return sorted((tuple(r) for r in lines.dedup_lines(docs, **options).collect()), key=str)


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["ÄÖÜ grün und blau", "äöü grün und blau", "short", "exactly 10", "nine char", "  padded by others  "]
    dress = lambda x: rng.choice(["", " ", "\t ", "\x0b"]) + rng.choice([x, x.upper() if x.isascii() else x, x]) + rng.choice(["", "\r", "  "])
    rows = []
    for d in rng.sample(range(1000), n):
        rows.append((d, "\n".join(rng.choice([dress(rng.choice(pool)), f"own line {rng.random()}", "", " ", "the same in all documents"]) for _ in range(rng.randrange(12)))))
    return rows


def test_equals_the_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("pos", F.lit(1))
    assert found(docs) == plain(rows)
    assert found(docs, min_docs=5, min_chars=6) == plain(rows, 6, 5)
    assert any(r[2] for r in found(docs))


def test_nulls_ties_and_repeated_rows(spark):
    shared = "a line of two documents"
    rows = [(5, shared), (5, shared), (5, f"other\n{shared}\n{shared}"), (9, f"{shared}\nrest"), (None, f"{shared}\nx"), (None, "only null ids have this\nonly null ids have this"), (None, "only null ids have this"),
            (11, None), (12, ""), (13, "\n\n"), (14, shared), (2, "repeated in one\nrepeated in one"), (15, "word " * 100_000), (16, "\n".join(["many of these lines"] * 30_000)), (17, "many of these lines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == plain(rows)
    assert lines.dedup_lines(docs.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    assert "Python" not in lines.dedup_lines(docs)._jdf.queryExecution().toString()
