"""Licence notices inside sentences, wrapped grants of the GNU family, SPDX identifiers; the SQL twin on the same texts."""

import duckdb
import pandas as pd

from starfold.llm import licenses
from starfold.llm.queries import ORACLES

WRAPPED = """/*
 * This {0} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {1} Public
 * License as published by the Free Software Foundation; either
 * version {2} of the License, or (at your option) any later version.
 *
 * This {0} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * {1} Public License for more details.
 */"""
TEXTS = [
    ("This project is licensed under the MIT License.", "MIT"), ("This file is released under the MIT License - see LICENSE", "MIT"),
    ("Licensed under the Apache License, Version 2.0 (see LICENSE)", "Apache-2.0"), ("Distributed under the terms of the GNU General Public License version 2.", "GPL-2.0-only"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    ("It is distributed under the\nterms of the GNU Lesser General\nPublic License version 2.1 or later.", "LGPL-2.1-or-later"),
    (WRAPPED.format("program", "General", "2"), "GPL-2.0-or-later"), (WRAPPED.format("library", "Lesser General", "2.1"), "LGPL-2.1-or-later"),
    (WRAPPED.format("program", "Affero General", "3"), "AGPL-3.0-or-later"), ("This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\nFITNESS. IN NO EVENT", "ISC"),
    ("We talked about the MIT license for an hour.", ""), ("He lived under the terms of the lease.", ""), ("licensed under the mit licensed act", ""), ("", ""), (None, ""),
    ("back\\slash | <b>Licensed under CC BY 4.0</b>\n||", "CC-BY-4.0"), ("SPDX-License-Identifier: MIT\nLicensed under the Apache License, Version 2.0", "Apache-2.0 MIT"),
]


def test_notices_and_the_sql_twin(spark):
    docs = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": [t for t, _ in TEXTS]})
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert list(zip(docs["doc_id"], got["licenses"])) == [(i, name) for i, (_, name) in enumerate(TEXTS)]
    con = duckdb.connect()
    con.register("documents", docs)
    twin = con.execute(ORACLES["op4_license_scan"]).df().sort_values("doc_id")
    assert twin[["n_found", "ids", "licenses"]].values.tolist() == got[["n_found", "ids", "licenses"]].values.tolist()


def test_no_known_sentence_lacks_a_sign():
    known = [s for s, _ in licenses.sentence_table(licenses.SENTENCES, licenses.NAMES)]
    assert all(any(x in s for x in licenses.SIGNS) or set(s.split(" ")) & set(licenses.SIGN_WORDS) for s in known)


def test_own_tables_need_no_sign(spark):
    d = spark.createDataFrame([(1, "Use it well. Share alike."), (2, None)], "doc_id long, text string")
    got = licenses.scan(d, {"a": "use it well", "b": "share alike"}, (("Own", ("a", "b")),)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, "a b", "Own"), (2, 0, "", "")]
