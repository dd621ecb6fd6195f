"""Source mix."""

import pytest
from pyspark.sql import functions as F

from starfold.llm import mixing


def rows(spark):
    data = [(i, f"s{i % 5}" if i % 7 else None, (i * 37) % 200 + (5000 if i % 41 == 0 else 0)) for i in range(400)] + [(400, "tiny", 1), (None, "tiny", 2), (401, "zero", 0), (402, "zero", None), (7, "s2", 59), (7, "s2", 59)]
    return data, spark.createDataFrame(data, "doc_id long, source string, size long")


def targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_targets_and_words(spark, block):
    data, df = rows(spark)
    sizes = {}
    for _, s, n in data:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    want = targets(sizes)
    got = mixing.taken_words(mixing.mix(df, block_words=block)).collect()
    assert len(got) == len(data)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) < 1, s
    again = mixing.taken_words(mixing.mix(df.repartition(7), block_words=block)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_slots_are_spread(spark):
    _, df = rows(spark)
    mixed = mixing.mix(df, block_words=16)
    order = [r["src"] for r in mixed.schedule.orderBy("slot").collect()]
    quota = {r["src"]: r["quota"] for r in mixed.sources.collect()}
    n = sum(quota.values())
    assert len(order) == n == mixed.schedule.select("slot").distinct().count()
    for part in (n // 8, n // 4, n // 2):
        for s, q in quota.items():
            assert abs(order[:part].count(s) - q * part / n) <= 12
    counts = mixed.schedule.groupBy("src", "pass", "block").count().where("count > 1")
    assert counts.count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "k"), (2, "d e f g", "y", "k"), (2, "d e f g", "y", "k"), (3, None, "x", None), (4, "", None, None), (5, "h", None, "k")], "doc_id long, text string, source string, size string")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert set(ids) <= {1, 2, 5} and max(map(ids.count, ids)) <= 4
    assert mixing.taken_words(mixing.mix(mixing.sizes_of(docs.where("false")))).count() == 0
    assert mixing.mix_documents(docs.where("text is null")).count() == 0
    bits = spark.range(8).select(mixing.reversed_bits(F.col("id"), 3).alias("r")).collect()
    assert [r["r"] for r in bits] == [0, 4, 2, 6, 1, 5, 3, 7]
