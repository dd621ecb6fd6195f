"""Licence scans by sentence rules.

Texts are normalised, cut where sentences may end, and known licence sentences from cut to cut are mapped to identifiers.  The identifiers of a document,
in order, are matched against rules: a rule is an ordered list of identifiers that must appear in that order.  Notices inside a
longer sentence are known by a verb, "under" and a licence's name.  Everything is built-in expressions over one row; there is no
shuffle.  The patterns have no look-around, so the SQL twin runs the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices.
SENTENCES = {
    "apache2.notice": "licensed under the apache license version 2 0",
    "apache2.grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2.see": "see the license for the specific language governing permissions and limitations under the license",
    "mit.notice": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl.redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.details": "see the gnu general public license for more details",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync4.notice": "licensed under cc by nc 4 0",
    "ccby4.notice": "licensed under cc by 4 0",
    "ccbysa4.notice": "licensed under cc by sa 4 0",
    "ccbync4.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "spdx.mit": "spdx license identifier mit",
    "spdx.apache2": "spdx license identifier apache 2 0",
    "spdx.gpl3only": "spdx license identifier gpl 3 0 only",
    "spdx.gpl3later": "spdx license identifier gpl 3 0 or later",
    "spdx.bsd3": "spdx license identifier bsd 3 clause",
    "reserved": "all rights reserved",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense.domain": "this is free and unencumbered software released into the public domain",
    "bsl.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "bsl.keep": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "lgpl.warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.details": "see the gnu lesser general public license for more details",
    "agpl.details": "see the gnu affero general public license for more details",
}
# The grant of the GNU family as (identifier, work, name, version); its wording is the same but for these.
GNU = (
    ("gpl2.redistribute", "program", "general", "2"), ("lgpl21.redistribute", "library", "lesser general", "2 1"),
    ("lgpl3.redistribute", "library", "lesser general", "3"), ("agpl3.redistribute", "program", "affero general", "3"),
)
SENTENCES |= {i: f"this {work} is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation "
              f"either version {v} of the license or at your option any later version" for i, work, name, v in GNU}
# SPDX identifiers, recognised behind "SPDX-License-Identifier:", besides those above.
SPDX = ("GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "ISC",
        "BSD-2-Clause", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "EPL-2.0", "BSL-1.0", "Zlib")
SENTENCES |= {f"spdx.{x.lower()}": "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ") for x in SPDX}
# Names of licences in notices; GNU names are made by rule below.
NAMES = {
    "MIT": ("mit license",), "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"), "ISC": ("isc license",),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license"), "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "Unlicense": ("unlicense",), "CC0-1.0": ("cc0 1 0 universal", "creative commons zero v1 0 universal"), "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"), "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"), "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
}
for _id, _name, _short, _versions in (("GPL", "general", "gpl", ("2.0", "3.0")), ("LGPL", "lesser general", "lgpl", ("2.1", "3.0")), ("AGPL", "affero general", "agpl", ("3.0",))):
    for _v in _versions:
        _said = [_v.replace(".", " "), *([_v[0]] if _v.endswith(".0") else [])]
        _forms = [f for w in _said for f in (f"gnu {_name} public license version {w}", f"gnu {_name} public license v{w}", f"{_short} version {w}", f"{_short}v{w}", f"{_short} {w}")]
        NAMES[f"{_id}-{_v}-only"] = tuple(_forms)
        NAMES[f"{_id}-{_v}-or-later"] = tuple(f"{f} or {later}" for f in _forms for later in ("later", "any later version", "at your option any later version"))

# Rules as (licence, identifiers in order).
RULES = (
    ("Apache-2.0", ("apache2.grant", "apache2.copy", "apache2.asis", "apache2.see")),
    ("Apache-2.0", ("apache2.notice",)), ("Apache-2.0", ("spdx.apache2",)),
    ("MIT", ("mit.grant", "mit.keep", "mit.asis", "mit.liability")),
    ("MIT", ("mit.notice",)), ("MIT", ("mit.licensed",)), ("MIT", ("spdx.mit",)),
    ("GPL-3.0-or-later", ("gpl.redistribute", "gpl.warranty", "gpl.details")), ("GPL-3.0-or-later", ("spdx.gpl3later",)),
    ("GPL-3.0-only", ("gpl3.notice",)), ("GPL-3.0-only", ("spdx.gpl3only",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name")), ("BSD-3-Clause", ("spdx.bsd3",)),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("CC-BY-NC-4.0", ("ccbync4.notice",)), ("CC-BY-NC-4.0", ("ccbync4.work",)),
    ("CC-BY-4.0", ("ccby4.notice",)), ("CC-BY-4.0", ("ccby4.work",)),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)), ("CC-BY-SA-4.0", ("ccbysa4.work",)),
    ("all-rights-reserved", ("reserved",)),
    ("GPL-2.0-or-later", ("gpl2.redistribute", "gpl.warranty", "gpl.details")), ("LGPL-2.1-or-later", ("lgpl21.redistribute", "lgpl.warranty", "lgpl.details")),
    ("LGPL-3.0-or-later", ("lgpl3.redistribute", "lgpl.warranty", "lgpl.details")), ("AGPL-3.0-or-later", ("agpl3.redistribute", "gpl.warranty", "agpl.details")),
    ("MPL-2.0", ("mpl2.form",)), ("ISC", ("isc.grant", "isc.asis")), ("Unlicense", ("unlicense.domain",)), ("BSL-1.0", ("bsl.grant", "bsl.keep")),
    *[(x, (f"spdx.{x.lower()}",)) for x in SPDX], *[(x, (f"notice.{x.lower()}",)) for x in NAMES],
)
# A rule whose identifiers begin those of another of the same text is left to the longer one.
SUPERSEDED = {"BSD-2-Clause": "BSD-3-Clause"}


#: Every known sentence and name holds one of these, or a word of ``SIGN_WORDS``; a text without any is not normalised.
SIGNS = ("licen", "warrant", "permission", "redistribut", "copyright", "rights", "domain", "commons", "gpl")
SIGN_WORDS = ("mpl", "cc", "cc0")
#: Replacements, in order, that make a lower-case text a row of ``<words>`` with ``||`` at each cut.
STEPS = (
    (r"([.!?;])[ \t]+", "\n"),
    (r"(?:^|\n)[^a-z0-9\n]*(?:(?:dnl|rem)[ \t]|[0-9a-z]{1,2}\)[ \t])", "\n"),  # comment words, and marks such as (1) or a)
    (r"[^a-z0-9\n]*\n[^a-z0-9]*", "||"),
    (r"[^a-z0-9|]+", " "),
    (r"([a-z0-9]+)", "<word>"),
    (r" ", ""),
)
VERBS = "licensed|released|distributed|available|covered|published"
CUT = r"(?:\|\|)?"


def words(sentence: str) -> str:
    """Pattern of a normalised sentence that may run over cuts."""
    return CUT.join(f"<{w}>" for w in sentence.split(" "))


def patterns(known: dict[str, str], names: dict[str, tuple[str, ...]], rules: tuple) -> str:
    """One pattern of all known sentences.

    A sentence begins and ends at a cut and may hold others, as wrapped lines, blank lines before an address and semicolons
    make; of two that begin at the same place the longer one counts.  Sentences of rules with several need no cut, as texts in one
    line have none behind a colon or an address, and a notice needs none.
    """
    longest = lambda some: sorted(some, key=lambda x: (-len(x), x))
    inside = {known[x] for _, rule in rules if len(rule) > 1 for x in rule if x in known}
    named = longest(n for forms in names.values() for n in forms)
    alone = longest({*known.values(), *named} - inside)
    choice = lambda some: "(?:" + "|".join(words(x) for x in some) + ")"
    parts = [choice(longest(inside))] if inside else []
    notice = [rf"<(?:{VERBS})>{CUT}<under>{CUT}(?:<the>{CUT})?(?:<terms>{CUT}<of>{CUT}(?:<the>{CUT})?)?{choice(named)}"] if named else []
    return "|".join([*parts, *([rf"\|{choice(alone)}\|"] if alone else []), *notice])


def signed(low: Column) -> Column:
    """Whether a lower-case text may hold a known sentence."""
    held = F.lit(False)
    for sign in SIGNS:
        held = held | low.contains(sign)
    for word in SIGN_WORDS:
        held = held | (low.contains(word) & low.rlike(rf"\b{word}\b"))
    return held


def marked(low: Column) -> Column:
    """Words of a lower-case text in angle brackets, with ``||`` at each cut: line ends and behind ``.!?;`` before a blank."""
    for pattern, new in STEPS:
        low = F.regexp_replace(low, pattern, {"<word>": "<$1>"}.get(new, new))
    return F.concat(F.lit("||"), low, F.lit("||"))


def identifiers(text: Column, known: dict[str, str], rules: tuple, names: dict[str, tuple[str, ...]]) -> Column:
    """Identifiers of the known sentences and notices in a marked text, in order."""
    found = F.regexp_extract_all(text, F.lit(patterns(known, names, rules)), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in sentence_table(known, names) for x in pair])
    plain = lambda m: F.regexp_replace(F.replace(F.regexp_replace(m, r"\|", ""), F.lit("><"), F.lit(" ")), "^<|>$", "")
    return F.transform(found, lambda m: F.coalesce(F.try_element_at(table, plain(m)), F.try_element_at(table, F.regexp_replace(plain(m), NOTICE, ""))))


#: What a notice says before the name.
NOTICE = f"^(?:{VERBS}) under (?:the )?(?:terms of (?:the )?)?"


def sentence_table(known: dict[str, str], names: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(normalised sentence or name, identifier); a sentence of its own comes before a name."""
    named = {n: f"notice.{x.lower()}" for x, forms in names.items() for n in forms}
    return list((named | {s: i for i, s in known.items()}).items())


def follows(ids: Column, rule: tuple[str, ...]) -> Column:
    """Whether the identifiers of a rule appear in their order; ``ids`` are joined by blanks between blanks."""
    return ids.rlike(".*".join(f" {x.replace('.', '[.]')} " if k == 0 else f"{x.replace('.', '[.]')} " for k, x in enumerate(rule)))


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: tuple = RULES, names: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_found, ids (identifiers in order) and licenses (names in code-point order), joined by blanks.

    Null and empty texts, and texts without a known sentence, have empty strings.  A sentence that comes twice counts twice and a
    licence is named once.  Columns other than doc_id and text are not read.
    """
    own, known, names = known is None, known or SENTENCES, NAMES if known is None and names is None else names or {}
    d = docs.select("doc_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__low"))
    found = identifiers(marked(F.col("__low")), known, rules, names)
    d = d.select("doc_id", F.when(signed(F.col("__low")) if own else F.lit(True), found).otherwise(F.array().cast("array<string>")).alias("__ids"))
    d = d.select("doc_id", F.size("__ids").cast("long").alias("n_found"), F.array_join("__ids", " ").alias("ids"))
    padded = F.concat(F.lit(" "), F.col("ids"), F.lit(" "))
    by_name: dict[str, Column] = {}
    for name, rule in rules:
        hit = follows(padded, rule)
        by_name[name] = by_name[name] | hit if name in by_name else hit
    plain = dict(by_name)
    for small, large in SUPERSEDED.items():
        if small in plain and large in plain:
            by_name[small] = plain[small] & ~plain[large]
    names = F.array_join(F.array(*[F.when(by_name[n], F.lit(n)) for n in sorted(by_name)]), " ")
    return d.withColumn("licenses", F.when(F.col("n_found") > 0, names).otherwise(F.lit("")))
