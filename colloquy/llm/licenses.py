"""Licence scans by sentence rules.

A text is normalised to its words: lower case, letters and digits, single blanks. Line wraps, comment marks and
punctuation are gone, so a notice reads the same on one line, hard-wrapped or in a source comment. Known
licence sentences are recognised in it as whole runs of words, the longest first, and each stands for an
identifier. The identifiers of a text, in order, are matched against an ordered list of rules; a rule is
a sequence of identifiers that names a licence. An earlier rule takes its sentences away from later
ones, so that a whole licence text is not also reported as the shorter ones it contains.

Everything is built-in functions in one projection; nothing is shuffled.

Defined results: a missing or empty text has no sentences and no licence; texts of any length are read whole;
rows that repeat give the same result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.planning import select_once
from colloquy.llm.common import whole_text

# Known sentences of public licences, normalised, by identifier.
SENTENCES = {
    "ApacheRef": ("licensed under the apache license version 2 0",),
    "ApacheGrant": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "you may not use this file except in compliance with the license",
    ),
    "ApacheCopy": ("you may obtain a copy of the license at http www apache org licenses license 2 0",),
    "ApacheAsIs": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "ApacheSee": ("see the license for the specific language governing permissions and limitations under the license",),
    "MitRef": ("released under the mit license", "licensed under the mit license", "licensed under the terms of the mit license"),
    "MitGrant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "MitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MitAsIs": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "Gpl3Ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "Gpl2Free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "Gpl2Ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "GplFree": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "GplNoWarranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "GplSee": ("see the gnu general public license for more details",),
    "GplCopy": ("you should have received a copy of the gnu general public license along with this program",),
    "BsdGrant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "BsdSource": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BsdBinary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "BsdEndorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "CcByRef": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "CcBySaRef": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "CcByNcRef": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "Cc0Ref": ("released under cc0 1 0", "licensed under cc0 1 0"),
    "AllRights": ("all rights reserved",),
    "SpdxApache": ("spdx license identifier apache 2 0",),
    "SpdxMit": ("spdx license identifier mit",),
    "SpdxBsd2": ("spdx license identifier bsd 2 clause",),
    "SpdxBsd3": ("spdx license identifier bsd 3 clause",),
    "SpdxGpl2": ("spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0"),
    "SpdxGpl2Later": ("spdx license identifier gpl 2 0 or later",),
    "SpdxGpl3": ("spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0"),
    "SpdxGpl3Later": ("spdx license identifier gpl 3 0 or later",),
}
# The rules in order of precedence, each a sequence of identifiers and a licence.
RULES = (
    (("ApacheGrant", "ApacheCopy", "ApacheAsIs", "ApacheSee"), "Apache-2.0"),
    (("ApacheRef", "ApacheGrant"), "Apache-2.0"),
    (("ApacheGrant", "ApacheCopy"), "Apache-2.0"),
    (("MitGrant", "MitNotice", "MitAsIs"), "MIT"),
    (("MitGrant", "MitNotice"), "MIT"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("GplFree", "GplNoWarranty", "GplSee", "GplCopy"), "GPL-3.0-or-later"),
    (("GplFree", "GplNoWarranty", "GplSee"), "GPL-3.0-or-later"),
    (("GplFree",), "GPL-3.0-or-later"),
    (("Gpl2Free", "GplNoWarranty", "GplSee", "GplCopy"), "GPL-2.0-or-later"),
    (("Gpl2Free", "GplNoWarranty", "GplSee"), "GPL-2.0-or-later"),
    (("Gpl2Free",), "GPL-2.0-or-later"),
    (("SpdxApache",), "Apache-2.0"),
    (("SpdxMit",), "MIT"),
    (("SpdxBsd2",), "BSD-2-Clause"),
    (("SpdxBsd3",), "BSD-3-Clause"),
    (("SpdxGpl2Later",), "GPL-2.0-or-later"),
    (("SpdxGpl2",), "GPL-2.0-only"),
    (("SpdxGpl3Later",), "GPL-3.0-or-later"),
    (("SpdxGpl3",), "GPL-3.0-only"),
    (("ApacheRef",), "Apache-2.0"),
    (("MitRef",), "MIT"),
    (("Gpl3Ref",), "GPL-3.0-only"),
    (("Gpl2Ref",), "GPL-2.0-only"),
    (("CcByNcRef",), "CC-BY-NC-4.0"),
    (("CcBySaRef",), "CC-BY-SA-4.0"),
    (("CcByRef",), "CC-BY-4.0"),
    (("Cc0Ref",), "CC0-1.0"),
    (("AllRights",), "LicenseRef-All-rights-reserved"),
)
KNOWN = {sentence: name for name, sentences in SENTENCES.items() for sentence in sentences}
# A known sentence as a run of whole words; of several that begin at a word the longest is taken.
RUN = rf"\b({'|'.join(sorted(KNOWN, key=lambda s: (-len(s), s)))})\b"
ENDS = r"([.!?;:])[\x20\t]+"
# Every known sentence holds one of these in a word.
HINTS = ("licens", "software", "redistribution", "rights", "cc0", "warranty")


def words_only(text: Column) -> Column:
    """Lower case, letters and digits only, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences_of(text: Column) -> Column:
    """Normalised sentences, which end with a line or at a mark before a blank; empty ones left out."""
    cut = F.split(F.regexp_replace(text, ENDS, "$1\n"), "\n")
    return F.filter(F.transform(cut, words_only), lambda s: s != "")


def identified(text: Column) -> Column:
    """The identifiers of the known sentences, in order; most texts hold no hint and are not searched."""
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.contains(F.lower(text), F.lit(hint))
    found = F.transform(F.regexp_extract_all(words_only(text), F.lit(RUN), F.lit(1)), lambda s: F.element_at(names, s))
    return F.when(hinted, found).otherwise(F.array().cast("array<string>"))


def matched(identifiers: Column) -> Column:
    """Licences of the rules that match, in the order of the rules, each once."""
    rules = F.array(*[F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("ids"), F.lit(name).alias("name")) for ids, name in RULES])
    begin = F.struct(
        F.array_join(F.transform(identifiers, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"),
        F.array().cast("array<string>").alias("names"),
    )

    def apply(state: Column, rule: Column) -> Column:
        return F.when(
            F.contains(state["left"], rule["ids"]),
            F.struct(
                F.replace(state["left"], rule["ids"], F.lit("|")).alias("left"),
                F.array_union(state["names"], F.array(rule["name"])).alias("names"),
            ),
        ).otherwise(state)

    return F.when(F.size(identifiers) > 0, F.aggregate(rules, begin, apply)["names"]).otherwise(F.array().cast("array<string>"))


def find_licenses(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id, ``n_sentences`` of the text, ``sentence_ids`` and ``licenses``, the last two arrays."""
    source = df.select(F.col(f"`{id_column}`").alias(id_column), whole_text(text_column).alias("_text"))
    text = F.col("_text")
    found = select_once(source, [id_column], {"n_sentences": F.size(sentences_of(text)).cast("long"), "_ids": identified(text)})
    return found.select(id_column, "n_sentences", F.col("_ids").alias("sentence_ids"), matched(F.col("_ids")).alias("licenses"))


def sql() -> str:
    """The same scan in SQL, over ``documents``; arrays are joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(n)})" for s, n in KNOWN.items())
    steps, last = [], "marked"
    for k, (ids, name) in enumerate(RULES):
        sequence = quote("".join(f"<{i}>" for i in ids))
        steps.append(
            f"r{k} AS (SELECT doc_id, replace(left_, {sequence}, '|') AS left_, CASE WHEN contains(left_, {sequence}) "
            f"AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names FROM {last})"
        )
        last = f"r{k}"
    run = RUN.replace("'", "''")
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
found AS (
  SELECT doc_id, regexp_extract_all(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), '{run}', 1) AS runs FROM documents
),
cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t]+', '\\1\n', 'g'), chr(10)) AS pieces FROM documents
),
sizes AS (SELECT doc_id, len(list_filter(pieces, lambda p: regexp_matches(lower(p), '[a-z0-9]'))) AS n_sentences FROM cut),
parts AS (SELECT doc_id, unnest(runs) AS sentence, unnest(range(len(runs))) AS place FROM found),
marked AS (
  SELECT f.doc_id, coalesce(string_agg('<' || k.name || '>', '' ORDER BY p.place) FILTER (k.name IS NOT NULL), '') AS left_,
    CAST([] AS VARCHAR[]) AS names,
    coalesce(string_agg(k.name, ',' ORDER BY p.place) FILTER (k.name IS NOT NULL), '') AS sentence_ids
  FROM found f LEFT JOIN parts p USING (doc_id) LEFT JOIN known k USING (sentence)
  GROUP BY f.doc_id
),
{', '.join(steps)}
SELECT m.doc_id, n_sentences, m.sentence_ids, array_to_string(r.names, ',') AS licenses
FROM marked m JOIN {last} r USING (doc_id) JOIN sizes USING (doc_id)
"""
