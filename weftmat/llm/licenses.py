"""License scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences, normalised (lower case, runs of other characters than letters and digits become one space)
and mapped to identifiers of known licence sentences. A licence rule is an ordered sequence of identifiers; it
matches where they occur in that order in a text's identifier sequence, other sentences between them being
allowed. Sentences are looked up with line ends as spaces (wrapped licence texts); where that finds nothing, the
sentence's lines are looked up one by one (one-line notices). So both kinds count in one text, in their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmat.llm.common import row_of, text_or_empty

# Sentences of public licence texts and of usual notices, as they are normalised, whole and in the pieces that ENDS leaves.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this software is released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license": "apache-2-header",
    "you may not use this file except in compliance with the license": "apache-2-comply",
    "you may obtain a copy of the license at": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-governing",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2-notice",
    "see the gnu general public license for more details": "gpl-details",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "see the gnu affero general public license for more details": "agpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-disclaimer",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "bsd-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0": "epl-2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl-1-notice",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl-1-notice",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "distributed under the boost software license version 1 0": "boost-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "all rights reserved": "all-rights-reserved",
    "spdx license identifier": "spdx",
}
#: Names after "SPDX-License-Identifier:", the identifiers of their sentences being "spdx-" and the name.
SPDX = ("MIT", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "Zlib", "BSL-1.0")
#: The family of GNU notices differs in the thing, the licence's name and the versions.
GNU = (("gpl", "program", "general", ("3", "2")), ("lgpl", "library", "lesser general", ("3", "2 1")), ("agpl", "program", "affero general", ("3",)))


def _gnu() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of the GNU notices: whole, and as ENDS cuts "free software: you", "Foundation; either", "WARRANTY; without"."""
    known, rules = {}, []
    implied = "without even the implied warranty of merchantability or fitness for a particular purpose"
    for short, thing, name, versions in GNU:
        for t in dict.fromkeys((thing, "program")):
            free, hope = f"this {t} is free software", f"this {t} is distributed in the hope that it will be useful but without any warranty"
            terms = f"you can redistribute it and or modify it under the terms of the gnu {name} public license"
            by = "as published by the free software foundation"
            known |= {free: "gnu-free", f"{free} {terms} {by}": f"{short}-free-terms", f"{terms} {by}": f"{short}-terms", hope: "gnu-without-warranty", f"{hope} {implied}": "gnu-no-warranty", implied: "gnu-without-implied"}
            for v in versions:
                later = f"either version {v} of the license or at your option any later version"
                i = f"{short}-{v.replace(' ', '.')}"
                known |= {later: f"gnu-{v.replace(' ', '.')}-later", f"{terms} {by} {later}": f"{i}-terms", f"{free} {terms} {by} {later}": f"{i}-grant"}
                known |= {f"{terms} version {v} {by}": f"{i}-only-terms", f"{free} {terms} version {v} {by}": f"{i}-only-grant"}
        for v in (x.replace(" ", ".") for x in versions):
            full = f"{short.upper()}-{v if '.' in v else v + '.0'}"
            grants = [(f"{short}-{v}-grant",), ("gnu-free", f"{short}-{v}-terms"), ("gnu-free", f"{short}-terms", f"gnu-{v}-later"), (f"{short}-free-terms", f"gnu-{v}-later")]
            only = [(f"{short}-{v}-only-grant",), ("gnu-free", f"{short}-{v}-only-terms")]
            for kind, ways in (("or-later", grants), ("only", only)):
                rules += [(f"{full}-{kind}", (*g, *w)) for g in ways for w in (("gnu-no-warranty",), ("gnu-without-warranty", "gnu-without-implied"))]
    return known, rules


_KNOWN, _RULES = _gnu()
#: What is looked up, and the ordered rules, the more demanding before those they contain.
KNOWN = SENTENCES | _KNOWN | {n.lower().replace("-", " ").replace(".", " "): f"spdx-{n}" for n in SPDX}
RULES = (
    ("Apache-2.0", ("apache-2-header", "apache-2-comply", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("Apache-2.0", ("apache-2-header",)),
    ("MIT", ("mit-grant", "mit-notice-kept", "mit-as-is")),
    ("MIT", ("mit-notice",)),
    *_RULES,
    ("GPL-3.0-only", ("gpl-3-notice",)),
    ("GPL-2.0-only", ("gpl-2-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice", "mpl-2-copy")),
    ("MPL", ("mpl-notice",)),
    ("EPL-2.0", ("epl-2-notice",)),
    ("EPL-1.0", ("epl-1-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-notice",)),
    ("Unlicense", ("unlicense-grant",)),
    ("CC0-1.0", ("cc0-dedication",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    *((n, ("spdx", f"spdx-{n}")) for n in SPDX),
    ("LicenseRef-all-rights-reserved", ("all-rights-reserved",)),
)
#: A sentence ends at . ! ? : ; before white space or the end, so "2.0" stays whole, and at an empty line, comment marks aside.
ENDS = {"wrapped": r"[.!?:;]+(?:\s+|$)|\n[\s*#/]*\n", "lines": r"[.!?:;]*(?:\n|$)|[.!?:;]+\s+"}


def _ids() -> str:
    """SQL: the identifiers of the known sentences of __low, in order."""
    known = ", ".join(f"'{s}', '{i}'" for s, i in KNOWN.items())
    look = lambda s: f"map({known})[trim(regexp_replace({s}, '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))]"
    heads = "|".join(dict.fromkeys(s.split(" ")[0] for s in KNOWN))
    # The cheap test on the first word leaves few sentences to normalise and look up.
    head = rf"[^\p{{L}}\p{{N}}]*(?:{heads})\b"
    pick = f"filter(split(__low, r'{ENDS['wrapped']}'), s -> s RLIKE r'(?:^|\\n){head}')"
    lines = f"filter(transform(filter(split(s, '\\n'), x -> x RLIKE r'^{head}'), x -> {look('x')}), i -> i IS NOT NULL)"
    # All ends of "wrapped" are ends of "lines"; within a wrapped sentence the only further ones are line ends.
    return f"flatten(transform({pick}, s -> transform(array({look('s')}), i -> CASE WHEN i IS NOT NULL THEN array(i) ELSE {lines} END)[0]))"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus __ids (known sentences in order) and __licenses (names of the rules that match, in rule order, each once).

    Null text is empty: no sentences, no licences; an empty table gives an empty result. All columns pass through whatever
    their names, but those named as the added ones are replaced.
    """
    df = docs.select(row_of(docs, "__ids", "__licenses"), F.lower(text_or_empty(text_col)).alias("__low"))
    df = df.select("row", F.expr(_ids()).alias("__ids"))
    order = list(dict.fromkeys(name for name, _ in RULES))

    def matches(rule: tuple[str, ...]) -> str:
        if len(rule) == 1:
            return f"array_contains(__ids, '{rule[0]}')"
        want = ", ".join(f"'{i}'" for i in rule)
        return f"(array_contains(__ids, '{rule[-1]}') AND aggregate(__ids, 0, (k, i) -> CASE WHEN k < {len(rule)} AND i = array({want})[least(k, {len(rule) - 1})] THEN k + 1 ELSE k END) = {len(rule)})"

    hits = ", ".join(f"CASE WHEN {' OR '.join(matches(r) for n, r in RULES if n == name)} THEN '{name}' END" for name in order)
    return df.select("row.*", "__ids", F.expr(f"CASE WHEN size(__ids) > 0 THEN array_compact(array({hits})) ELSE cast(array() AS array<string>) END").alias("__licenses"))


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences), sentence_ids and licenses, comma-joined."""
    df = scan(docs.select("doc_id", "text"))
    return df.select("doc_id", F.size("__ids").cast("bigint").alias("n_known"), F.array_join("__ids", ",").alias("sentence_ids"), F.array_join("__licenses", ",").alias("licenses"))
