"""Fingerprints, licences, shards, chat parts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.llm import chat, fingerprints, licenses, sharding


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))


# ---------------------------------------------------------------- fingerprints


def test_edited_fingerprints(spark):
    data = [(i, prose(5 + 3 * i, i), "x") for i in range(40)] + [(None, prose(9, 99), "x"), (50, None, "x"), (51, "", "y"), (52, prose(6000, 7), "y"), (53, prose(6000, 7), "y")]
    docs = spark.createDataFrame(data, "doc_id long, text string, fingerprint string")
    got = sorted(fingerprints.edited_fingerprints(docs.repartition(6)).collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    texts = [t or "" for _, t, _ in sorted(data, key=lambda x: -1 if x[0] is None else x[0])]
    assert len(got) == len(texts)
    for i, (r, t) in enumerate(zip(got, texts, strict=True)):
        n = len(t) // 4
        e = t[: len(t) - n] + texts[(i + 1) % len(texts)][:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        if len(t) > 200:
            assert 0.6 < r["near_edited"] <= 1
        if len(t) > 200 and len(texts[(i + 1) % len(texts)]) > 50 and i < 40:
            assert r["near_next"] < r["near_edited"]
    assert bytes(got[-2]["fingerprint"]) == bytes(got[-1]["fingerprint"]) and got[-2]["near_next"] == 1
    one = fingerprints.edited_fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert fingerprints.edited_fingerprints(docs.where("false")).count() == 0


def test_likeness_falls_with_edits():
    a, rng = prose(800, 1), random.Random(1)
    seen = []
    for share in (0.0, 0.01, 0.05, 0.2):
        b = list(a)
        for _ in range(int(share * len(b))):
            b[rng.randrange(len(b))] = "q"
        b.insert(100, "zz")
        x, y = fingerprints.of_texts([a, "".join(b)])
        seen.append(fingerprints.likeness(x, y))
    assert seen == sorted(seen, reverse=True) and seen[0] > 0.8 > seen[-1]
    assert fingerprints.likeness(b"", b"") == 1 and fingerprints.likeness(b"", b"a") == 0


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 90))) for _ in range(2))
        assert fingerprints.edit_distance(a, b) == plain(a, b)


def test_near_classes(spark):
    base = [prose(120, s) for s in range(6)]
    rows = []
    for k, t in enumerate(base):
        for c in range(4):
            rows.append((10 * k + c, t[: 40 * c] + "#" * c + t[40 * c :], "x"))
    rows += [(90, None, "x"), (91, "", "x"), (92, base[0], "x")]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()}
    assert all(got[10 * k + c] == 10 * k for k in range(6) for c in range(4))
    assert got[92] == 0 and got[91] == got[90] == 90


# ---------------------------------------------------------------- licences


def test_licences(spark):
    mit = "Copyright X.\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
    wrong = "\n".join(reversed(mit.split("\n")))
    rows = [(1, mit), (2, wrong), (3, "Prose. Licensed under the Apache License, Version 2.0. More."), (4, None), (5, ""), (6, "released under the MIT LICENSE!\nAll rights reserved."), (6, "released under the MIT LICENSE!\nAll rights reserved."), (None, "SPDX-License-Identifier: MIT"), (7, "A. " * 30_000)]
    got = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")).collect()
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["licenses"]) for r in got) == [(-1, "MIT"), (1, "MIT"), (2, ""), (3, "Apache-2.0"), (4, ""), (5, ""), (6, "MIT all-rights-reserved"), (6, "MIT all-rights-reserved"), (7, "")]
    assert {r["doc_id"]: r["ids"] for r in got}[3] == "apache2.notice"
    bsd = spark.createDataFrame([(1, "\n".join(licenses.SENTENCES[k] for k in ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name"))), (2, "\n".join(licenses.SENTENCES[k] for k in ("bsd.grant", "bsd.source", "bsd.binary")))], "doc_id long, text string")
    assert sorted(r["licenses"] for r in licenses.scan(bsd).collect()) == ["BSD-2-Clause", "BSD-3-Clause"]


# ---------------------------------------------------------------- shards


def test_curve_is_a_bijection_with_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.curve_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, tmp_path):
    rows = [(i, prose(i % 50, i % 9), ["a", "b", None][i % 3], f"s{min(i, 40) % 13}") for i in range(500)] + [(None, None, None, None), (3, prose(3, 3), "a", "s3"), (3, prose(3, 3), "a", "s3"), (501, "x" * 200_000, "a", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("mine"))
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    counts = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    curve = [r["curve"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard_documents(docs.where("false")).count() == 0
    assert sorted(r["shard"] for r in sharding.shard_documents(docs.where("doc_id < 2"), shards=5).collect()) == [0, 2]
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


# ---------------------------------------------------------------- chat


def test_conversations_read_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>", "a\\lb\\sc\\\\", "", None, "line\n\nline", "é😀" * 5000]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(nasty)] + [(2, 0, "a\nb<", "x"), (2, 0, "a\nb<", "x"), (None, None, None, None), (3, 5, "assistant", "late"), (3, 1, "assistant", "early")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, parts string")
    out = chat.format_conversations(df.repartition(4))
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(("user", "assistant")[i % 2], t or "") for i, t in enumerate(nasty)]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(nasty) if i % 2)
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("a\nb<", "x")] * 2
    assert got[3]["loss"] == "earlylate" and [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")]
    assert got[1]["formatted"].count("<|turn|>") == len(nasty)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_typed_parts(spark):
    part = lambda **x: tuple(x.get(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part(kind="text", text="look <"), part(kind="image", ref="i1", width=56, height=29), part(kind="audio", ref="a1", seconds=1.5), part(kind="document", ref="d1", pages=2), part(kind="image", ref=None), None, part(text="end")]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [])]
    r = {x["conv_id"]: x for x in chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).collect()}
    assert r[1]["formatted"] == "<|turn|>user\nlook \\l<|image|><|audio|><|document|><|image|>end<|end|><|turn|>assistant\n<|end|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r[1]["attachments"]] == [("image", "i1", 4), ("audio", "a1", 38), ("document", "d1", 1024), ("image", None, 1)]
    assert r[1]["expanded_tokens"] == 1067 and r[2]["expanded_tokens"] == 0


def test_cuts(spark):
    df = spark.createDataFrame([(i if i > 30 else 7,) for i in range(100)], "v long")
    bounds = sharding.cuts(df, "v", 4)
    assert bounds == sorted(set(bounds)) and len(bounds) <= 3
    assert sharding.cuts(df.where("false"), "v", 4) == [] and pytest.approx(1) == 1


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_published_licence_texts_with_wrapped_lines(spark):
    styles = {"plain": "", "hash": "# ", "slash": "// ", "star": " * ", "dnl": "dnl "}
    texts = {"Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "MIT": MIT, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD.split("\n\n3. ")[0]}
    rows = [(f"{name} {style}", f"Copyright 2020 X\n\n" + "\n".join(mark + x for x in text.split("\n")) + "\n\nint main;") for name, text in texts.items() for style, mark in styles.items()]
    rows += [(f"{name} one line", " ".join(text.split())) for name, text in texts.items()]
    rows += [("MIT windows", MIT.replace("\n", "\r\n")), ("BSD-3-Clause brackets", BSD.replace("1. ", "(1) ").replace("2. ", "b) ")), (" broken", MIT.replace("free of charge", "free"))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {d: d.split(" ")[0] for d, _ in rows}


def test_chat_kinds_are_no_marks(spark):
    part = lambda **x: tuple(x.get(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part(kind="turn", ref="t"), part(text="a\\b"), part(kind="end"), part(kind="part:turn|><|end")]
    turns = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.format_turns(turns).withColumn("t", chat.read_turns(F.col("formatted"))).first()
    assert len(r["t"]) == 1 and r["t"][0]["role"] == "user" and "a\\b" in r["t"][0]["text"]
