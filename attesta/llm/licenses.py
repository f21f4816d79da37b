"""Licence scans: sentences to identifiers, identifier sequences to licences.

A text is lower-cased, and the comment signs that begin its lines are taken off.  It is then cut into sentences at blank lines
and at ``.``, ``!``, ``?``, ``;`` or ``:`` before white space, so that a wrapped sentence is one; the text's lines
are tried as sentences too, for statements that stand in a line without a stop.  In a sentence every run of other characters than
letters and digits becomes one space, the party that a clause names becomes ``_``, and what leads to a licence's name
("this project is licensed under the terms of the") becomes ``under``.  A sentence of ``SENTENCES`` becomes its identifier.
``RULES`` are tried in order on the identifiers in text order: a rule matches where its identifiers follow each other
with nothing but other identifiers between, and a rule that a former match covers is passed over.

All of it is array functions inside a row: no shuffle, no join.

Edge cases: a null or empty text has no identifiers and no licences; null doc_ids pass through; repeated rows get equal
results; an empty table gives an empty table; clashing input columns give way to the result's.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, replaced

# Licences by SPDX identifier, with the names that statements and titles give them (normalised).
NAMES = {
    "MIT": ["mit license", "mit", "expat license", "mit expat license"],
    "MIT-0": ["mit no attribution", "mit no attribution license"],
    "Apache-1.1": ["apache software license version 1 1"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0", "apache license version 2 0 january 2004"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2 0", "gnu general public license version 2 june 1991", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gplv2", "gpl v2"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3 0", "gnu general public license version 3 29 june 2007", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gplv3", "gpl v3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lesser general public license version 2 1 february 1999", "gnu lgpl version 2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lesser general public license version 3 29 june 2007", "gnu lgpl version 3", "lgpl version 3", "lgplv3"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu affero general public license version 3 19 november 2007", "gnu agpl version 3", "agplv3"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause new or revised license"],
    "BSD-4-Clause": ["bsd 4 clause license", "original bsd license", "bsd 4 clause original or old license"],
    "ISC": ["isc license", "internet systems consortium license"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1", "mpl 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mpl 2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license v 2 0"],
    "EUPL-1.2": ["european union public licence version 1 2", "european union public licence v 1 2", "eupl version 1 2"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0", "cddl version 1 0"],
    "Artistic-1.0": ["artistic license 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license version 1 0 august 17th 2003"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "sil open font license version 1 1 26 february 2007"],
    "PSF-2.0": ["python software foundation license version 2", "psf license agreement"],
    "NCSA": ["university of illinois ncsa open source license"],
    "PostgreSQL": ["postgresql license"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["do what the fuck you want to public license", "do what the fuck you want to public license version 2 december 2004"],
    "CC0-1.0": ["cc0 1 0 universal", "cc0 1 0", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal", "cc0 1 0 universal public domain dedication"],
}
# What the parts of a Creative Commons licence's name stand for, and the versions' suffixes.
CC_PARTS = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = {"2 0": "generic", "2 5": "generic", "3 0": "unported", "4 0": "international"}
# Sentences of licence texts and notices (normalised), with their identifiers.
TEXTS = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-limits": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of _ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by _ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "mpl-2-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-2-form-whole": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-2-copy-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-1-1-version": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl-2-materials": "under eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-2-materials-v": "under eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1-materials": "under eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "gpl-program": "this program is free software",
    "gpl-library": "this library is free software",
    "cc0-waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "wtfpl-verbatim": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "all-rights": "all rights reserved",
}
# Licences and the identifier sequences of their texts, the longer before the shorter.
TEXT_RULES = [
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT-0", ["mit-0-grant"]),
    ("Apache-2.0", ["apache-compliance", "apache-as-is", "apache-limits"]),
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-advertising", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("MPL-2.0", ["mpl-2-form"]),
    ("MPL-2.0", ["mpl-2-form-whole"]),
    ("MPL-2.0", ["mpl-2-copy"]),
    ("MPL-2.0", ["mpl-2-copy-http"]),
    ("MPL-1.1", ["mpl-1-1-version"]),
    ("EPL-2.0", ["epl-2-materials"]),
    ("EPL-2.0", ["epl-2-materials-v"]),
    ("EPL-1.0", ["epl-1-materials"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Unlicense", ["unlicense-domain"]),
    ("WTFPL", ["wtfpl-verbatim"]),
    ("LicenseRef-all-rights-reserved", ["all-rights"]),
]
#: The GNU licences: SPDX name, how a notice names it, and the versions with the words that notices use.
GNU = {"GPL": ("general", ["1", "2", "3"]), "LGPL": ("lesser general", ["2 1", "3"]), "AGPL": ("affero general", ["3"])}


#: Every known sentence, as written, holds one of these; a text without any is not cut at all.
KEYS = ("license", "licence", "spdx", "permission", "permitted", "redistribut", "warrant", "software", "reserved", "unencumbered", "waived", "acknowledgement", "cc0", "cc ", "cc-", "commons", "gpl", "mpl", "cddl", "eupl", "under")


def _tables() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """(sentences and their identifiers, rules): the fixed texts, and by rule what names and GNU notices give."""
    known, rules = {text: name for name, text in TEXTS.items()}, list(TEXT_RULES)
    gnu = []
    for spdx, (kind, versions) in GNU.items():
        terms = f"you can redistribute it and or modify it under the terms of the gnu {kind} public license"
        by = "as published by the free software foundation"
        known[f"{terms} {by}"] = f"{spdx.lower()}-terms"
        for v in versions:
            n, dash = (v.replace(" ", ".") if " " in v else f"{v}.0"), v.replace(" ", "-")
            later = f"either version {v} of the license or at your option any later version"
            known[later] = f"either-{dash}"
            known[f"{terms} {by} {later}"] = f"{spdx.lower()}-terms-either-{dash}"
            known[f"{terms} {by} version {v} of the license"] = known[f"{terms} version {v} {by}"] = f"{spdx.lower()}-terms-only-{dash}"
            gnu += [(f"{spdx}-{n}-or-later", [f"{spdx.lower()}-terms", f"either-{dash}"]), (f"{spdx}-{n}-or-later", [f"{spdx.lower()}-terms-either-{dash}"]), (f"{spdx}-{n}-only", [f"{spdx.lower()}-terms-only-{dash}"])]
    names = dict(NAMES)
    for part, words in CC_PARTS.items():
        for v, suffix in CC_VERSIONS.items():
            spdx = f"CC-{part.upper().replace(' ', '-')}-{v.replace(' ', '.')}"
            forms = {words, words.replace("noncommercial", "non commercial"), words.replace("sharealike", "share alike")}
            names[spdx] = [f"cc {part} {v}", f"creative commons {part} {v}", *sorted(f"creative commons {w} {v} {suffix}" for w in forms), *sorted(f"creative commons {w} {v}" for w in forms)]
    stated = []
    for spdx, own in names.items():
        name = f"{spdx.lower().replace('.', '-')}-name"
        stated.append((spdx, [name]))
        later = spdx.replace("-only", "-or-later") if spdx.endswith("-only") else None
        plain = " ".join(spdx.lower().replace(".", " ").replace("-", " ").split())
        known[f"spdx license identifier {plain}"] = name
        if later:
            stated.append((later, [f"{name}-or-later"]))
            known[f"spdx license identifier {plain.replace(' only', ' or later')}"] = f"{name}-or-later"
            known[f"spdx license identifier {plain.replace(' only', '')}"] = name
        for n in own:
            for form in dict.fromkeys((n, n if n.endswith(("license", "licence")) else f"{n} license")):
                known[f"under {form}"] = known[f"under {form} the license"] = name
                if " " in form and any(k in form for k in KEYS):  # as a title; a single word says too little
                    known[form] = known[f"the {form}"] = name
                if later:
                    known[f"under {form} or later"] = known[f"under {form} or any later version"] = f"{name}-or-later"
    known["spdx license identifier mit or apache 2 0"] = known["spdx license identifier apache 2 0 or mit"] = "mit-or-apache-2-0"
    stated += [("MIT", ["mit-or-apache-2-0"]), ("Apache-2.0", ["mit-or-apache-2-0"])]
    return known, [*gnu, *rules[:-1], *stated, rules[-1]]


SENTENCES, RULES = _tables()
#: Longest and shortest known sentence; a sentence as written may be longer by its punctuation.
LEAST = min(map(len, SENTENCES))

# Patterns in the syntax that Java and RE2 share.
LEADER = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--+|dnl[ \t]|rem[ \t])[ \t]*"
LABEL = r"(identifier|license|licence):[ \t]+"
STOP = r"[.!?;:]+[\"')\]]*(?:\s+|\z)|\n[ \t\r]*\n\s*"
LINE = r"[.!?;:]+[\"')\]]*(?:\s+|\z)|\n\s*"
OTHER = "[^a-z0-9]+"
PARTY = r"^(neither the name of|this software is provided by|in no event shall) .+? (nor the names of|as is|be liable)"
UNDER = (
    r"^(?:(?:this|the) (?:work|project|software|program|library|code|source code|file|package|module|document|documentation|repository|article|text|content|this)(?: and the accompanying materials)? )?(?:(?:is|are|was) )?(?:free software )?(?:dual )?"
    r"(?:made )?(?:licensed|released|distributed|available|published|provided|shared|licenced) under (?:the terms of )?(?:(?:the|a|an) )?"
)


def _pattern(sequence: list[str]) -> str:
    """A regular expression for '<id><id>...' in which the sequence occurs in order."""
    return "(?:<[^>]*>)*".join(f"<{s}>" for s in sequence)


def _covering(k: int) -> list[int]:
    """Former rules whose identifiers hold those of rule k."""
    return [j for j in range(k) if set(RULES[k][1]) < set(RULES[j][1])]


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences in text order, then those that lines alone give."""
    by_length = [[s for s in SENTENCES if len(s) == n] for n in range(max(map(len, SENTENCES)) + 1)]
    # foldable: the optimizer makes constants of them, once a query
    known = F.from_json(F.lit(json.dumps(by_length)), "array<array<string>>")
    names = F.from_json(F.lit(json.dumps([[SENTENCES[s] for s in group] for group in by_length])), "array<array<string>>")

    def named(s: Column) -> Column:
        return F.get(F.get(names, F.length(s)), (F.array_position(F.get(known, F.length(s)), s) - 1).cast("int"))

    def plain(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(s, OTHER, " ")), PARTY, "$1 _ $2"), UNDER, "under ")

    def found(t: Column, stop: str) -> Column:
        cut = F.transform(F.filter(F.split(t, stop), lambda s: F.length(s) >= LEAST), plain)
        return F.array_compact(F.transform(cut, named))

    def both(t: Column) -> Column:
        return F.struct(found(t, STOP).alias("a"), found(t, LINE).alias("b"))

    lower = F.lower(text)
    bare = F.regexp_replace(F.regexp_replace(lower, LEADER, "$1"), LABEL, "$1 ")
    ids = let(let(bare, both), lambda x: F.concat(x["a"], F.filter(x["b"], lambda i: ~F.array_contains(x["a"], i))))
    some = reduce(or_, [lower.contains(k) for k in KEYS])
    return F.when(some, ids).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with ``license_sentences`` (identifiers in order), ``licenses`` (distinct, in rule order) and ``n_license_sentences``."""
    df = replaced(docs, {"license_sentences": sentence_ids(F.col("text"))})
    line = F.concat(F.lit("<"), F.array_join("license_sentences", "><"), F.lit(">"))

    def found(s: Column) -> Column:
        hits = [s.rlike(_pattern(seq)) for _, seq in RULES]
        own = []
        for k, (name, _) in enumerate(RULES):
            hit = hits[k]
            for j in _covering(k):
                hit = hit & ~hits[j]
            own.append(F.when(hit, F.lit(name)))
        return F.array_distinct(F.array_compact(F.array(*own)))

    none = F.array().cast("array<string>")
    licenses = F.when(F.size("license_sentences") == 0, none).otherwise(let(line, found))
    return replaced(df, {"licenses": licenses, "n_license_sentences": F.size("license_sentences").cast("long")})


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known, names = ", ".join(map(quote, SENTENCES)), ", ".join(map(quote, SENTENCES.values()))
    norm = f"regexp_replace(regexp_replace(trim(regexp_replace(x, {quote(OTHER)}, ' ', 'g')), {quote(PARTY)}, '\\1 _ \\2'), {quote(UNDER)}, 'under ')"
    ids = lambda stop: f"list_filter(list_transform(list_filter(regexp_split_to_array(t, {quote(stop)}), lambda x: length(x) >= {LEAST}), lambda x: [{names}][list_position([{known}], {norm})]), lambda i: i IS NOT NULL)"
    cases = []
    for k, (name, seq) in enumerate(RULES):
        hit = f"regexp_matches(line, '{_pattern(seq)}')" + "".join(f" AND NOT regexp_matches(line, '{_pattern(RULES[j][1])}')" for j in _covering(k))
        cases.append(f"CASE WHEN {hit} THEN '{name}' END")
    ranks = ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in RULES))
    return f"""
WITH plain AS (
  SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), {quote(LEADER)}, '\\1', 'g'), {quote(LABEL)}, '\\1 ', 'g') AS t FROM documents
), cut AS (
  SELECT doc_id, {ids(STOP)} AS a, {ids(LINE)} AS b FROM plain
), seq AS (
  SELECT doc_id, a || list_filter(b, lambda i: NOT list_contains(a, i)) AS ids FROM cut
), lines AS (
  SELECT doc_id, array_to_string(ids, ',') AS license_sentences, '<' || array_to_string(ids, '><') || '>' AS line, len(ids) AS n FROM seq
), hits AS (
  SELECT doc_id, license_sentences, n, CASE WHEN n = 0 THEN [] ELSE [{", ".join(cases)}] END AS l FROM lines
)
SELECT doc_id, license_sentences, array_to_string(list_filter([{ranks}], lambda x: list_contains(l, x)), ',') AS licenses, CAST(n AS BIGINT) AS n_license_sentences FROM hits
"""


ORACLE = _oracle()
