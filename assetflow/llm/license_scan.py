"""License scans by sentence-rule recognition."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences after normalisation (lower case, other than a-z and 0-9 to one space).
SENTENCES = {
    "mit-name": "mit license",
    "mit-name-the": "the mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-mit": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache2-short": "licensed under the apache license version 2 0",
    "apache2-the": "licensed under the apache license version 2 0 the license",
    "apache2-may": "you may not use this file except in compliance with the license",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-only": "licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-4-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-waiver": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache2": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "rights": "all rights reserved",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-liable": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liable": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache2-title": "apache license version 2 0 january 2004",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "eclipse2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
}

# Rules in the order in which they are tried; a matched run of sentences is used up.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is", "bsd-liable"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liable"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is-mit", "mit-liable"]),
    ("MIT", ["mit-name-the", "mit-grant", "mit-notice", "as-is-mit", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit", "mit-liable"]),
    ("ISC", ["isc-grant", "isc-as-is", "isc-liable"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("Unlicense", ["unlicense", "unlicense-anyone"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("EPL-2.0", ["eclipse2"]),
    ("Apache-2.0", ["apache2-title"]),
    ("Apache-2.0", ["apache2-the", "apache2-may", "apache2-asis", "apache2-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-name-the", "mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache2-the", "apache2-may", "apache2-asis"]),
    ("Apache-2.0", ["apache2-the"]),
    ("Apache-2.0", ["apache2-short"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl3-only"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-project"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-the"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-long"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-long"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Unlicense", ["unlicense"]),
]

# Parts of the public names of licences, from which further sentences and rules follow.
_SPDX = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0"]
_CC_TERMS = {"BY": "attribution", "NC": "noncommercial", "ND": "noderivatives", "SA": "sharealike"}
_CC = [(terms, version) for version in ("3.0", "4.0") for terms in (["BY"], ["BY", "SA"], ["BY", "NC"], ["BY", "ND"], ["BY", "NC", "SA"], ["BY", "NC", "ND"])]


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def _named() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Sentences and rules that follow from names: identifiers in source files, and Creative Commons licences in two wordings."""
    sentences, rules = {}, []
    for name in _SPDX:
        sentences[f"spdx-{name}"] = _plain(f"SPDX-License-Identifier: {name}")
        rules.append((name, [f"spdx-{name}"]))
    for terms, version in _CC:
        name, place = f"CC-{'-'.join(terms)}-{version}", "international" if version == "4.0" else "unported"
        wordings = [f"licensed under CC {'-'.join(terms)} {version}", f"this work is licensed under a Creative Commons {'-'.join(_CC_TERMS[t] for t in terms)} {version} {place} license"]
        for i, wording in enumerate(map(_plain, wordings)):
            if wording not in SENTENCES.values():
                sentences[f"{name}-{i}"] = wording
                rules.append((name, [f"{name}-{i}"]))
    return sentences, rules


for _sentences, _rules in [_named()]:
    SENTENCES.update(_sentences)
    RULES.extend(_rules)

#: A text with none of these has no sentence of SENTENCES.
CUE = r"(?i)licen[sc]e|permi|distribut|warrant|copyright|rights|public|liable|mpl"


def cue(sentences: dict[str, str]) -> str:
    """A pattern that every text with one of the sentences matches: the longest word of each."""
    return "(?i)" + "|".join(sorted({re.escape(max(s.split(), key=len, default="")) for s in sentences.values()}))


#: Comment marks that are words or end like a sentence, at the begin of a line.
MARK = r"(?m)^[ \t]*(?:@?[Rr][Ee][Mm]|dnl|[#*/%>-]*[;!:.]+)(?:[ \t]+|$)"


def normalised_sentences(text: Column) -> Column:
    """Sentences of a text: it breaks at line ends and after . ! ? ; : before white space; a line that begins with a small letter goes on from the line before."""
    bare = F.regexp_replace(F.regexp_replace(text, MARK, " "), r"[ \t]++(?=[\r\n])", "")
    joined = F.regexp_replace(bare, r"(?<![\r\n])\r?\n([a-z])", " $1")
    broken = F.regexp_replace(joined, r"([.!?;:])[ \t]+", "$1\n")
    return F.transform(F.split(broken, r"\r\n|[\r\n]"), lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")))


def known_sentences(text: Column, known: dict[str, str]) -> Column:
    """Known sentences of a text in their order.  One may be broken anywhere, as by wrapped lines or "v. 2.0": it is a run of whole parts, but none goes on behind an empty line."""
    parts = F.concat(F.lit("|"), F.array_join(normalised_sentences(text), "|"), F.lit("|"))
    any_of = "|".join(s.replace(" ", "[ |]") for s in sorted(known.values(), key=len, reverse=True))
    return F.transform(F.regexp_extract_all(parts, F.lit(rf"\|(?:{any_of})(?=\|)"), F.lit(0)), lambda s: F.translate(F.substr(s, F.lit(2)), "|", " "))


def license_scan(documents: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Licences named or quoted in every text: doc_id, n_known (known sentences), licenses (by rule order, joined by |), n_unmatched.

    Every sentence of the whole text is normalised and mapped to its identifier, also where lines,
    comment marks or punctuation break it; sentences that aren't known drop out of the sequence.  The ordered rules are tried on the sequence, and each
    match uses its sentences up.  A null or empty text has none and an empty list.  Rows are scanned
    one by one (no shuffle); repeated rows and null doc_ids give rows; other columns aren't read.
    The tables of sentences and rules are small; the caller may give others (sentences normalised, each of a
    word at least).
    """
    known, order = SENTENCES if sentences is None else sentences, RULES if rules is None else rules
    if not known:
        known = {"": "\n"}  # no text has it
    pairs = [F.lit(x) for name, s in known.items() for x in (s, f"<{name}>")]
    ids = F.transform(known_sentences(F.col("text"), known), lambda s: F.element_at(F.create_map(*pairs), s))
    found = documents.select("doc_id", F.coalesce(F.when(F.col("text").rlike(CUE if sentences is None else cue(known)), ids), F.array().cast("array<string>")).alias("ids"))
    steps = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in run)).alias("run")) for name, run in order)).cast("array<struct<name: string, run: string>>")
    begin = F.struct(F.array_join("ids", "").alias("left"), F.array().cast("array<string>").alias("names"))
    step = lambda a, r: F.struct(F.replace(a["left"], r["run"], F.lit("|")).alias("left"), F.when(F.contains(a["left"], r["run"]), F.array_append(a["names"], r["name"])).otherwise(a["names"]).alias("names"))
    matched = found.withColumn("m", F.when(F.size("ids") > 0, F.aggregate(steps, begin, step)).otherwise(begin))
    return matched.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_known"),
        F.array_join(F.array_distinct("m.names"), "|").alias("licenses"),
        F.regexp_count("m.left", F.lit("<")).cast("bigint").alias("n_unmatched"),
    )


def sql() -> str:
    """The same over a table documents, as DuckDB SQL; it knows a sentence only where no break is within."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(s)}, {quote(n)})" for n, s in SENTENCES.items())
    steps, before = [], "r0"
    for i, (name, run) in enumerate(RULES, 1):
        seq = quote("".join(f"<{x}>" for x in run))
        steps.append(f"r{i} AS (SELECT doc_id, row, n_known, replace(rest, {seq}, '|') AS rest, CASE WHEN contains(rest, {seq}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {before})")
        before = f"r{i}"
    return rf"""
        WITH k(sentence, id) AS (VALUES {table}),
        d AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
        b AS (SELECT doc_id, row, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '\r?\n([a-z])', ' \1', 'g'), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]') AS s FROM d),
        e AS (SELECT row, unnest(s) AS s, generate_subscripts(s, 1) AS p FROM b),
        m AS (SELECT row, string_agg('<' || id || '>', '' ORDER BY p) AS rest, count(*) AS n FROM e JOIN k ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY row),
        r0 AS (SELECT d.doc_id, d.row, coalesce(n, 0) AS n_known, coalesce(rest, '') AS rest, []::VARCHAR[] AS names FROM d LEFT JOIN m ON d.row = m.row),
        {", ".join(steps)},
        u AS (SELECT row, string_agg(name, '|' ORDER BY p) AS licenses FROM (SELECT row, name, min(p) AS p FROM (SELECT row, unnest(names) AS name, generate_subscripts(names, 1) AS p FROM {before}) GROUP BY row, name) GROUP BY row)
        SELECT doc_id, n_known::BIGINT AS n_known, coalesce(licenses, '') AS licenses, (length(rest) - length(replace(rest, '<', '')))::BIGINT AS n_unmatched FROM {before} LEFT JOIN u ON {before}.row = u.row"""
