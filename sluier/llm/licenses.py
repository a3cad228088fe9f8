"""License scans by sentence rules, in DataFrame functions only.

Wrapped lines are joined again, then a text is cut into sentences (at line ends and after . ! ? before white space) and normalised
(lower case, only letters, digits and single blanks). One expression finds the known licence sentences in them: openings of
licence texts, grants ("distributed under the terms of the ..."), and titles, the last two with the names of a catalogue; what it finds is mapped to
an identifier. The sequence of identifiers is then matched against ordered rules: a rule is a sequence that must stand in a row;
longer rules come first and use up their sentences, so the clauses of a licence aren't found a second
time as a shorter one. What is left and names a licence by itself is that licence. Names in SPDX expressions are taken as written.
The SQL is made of the same tables. Work is row by row: nothing is shuffled.

Defined cases: null and empty texts have no sentences; a known sentence that no rule uses is counted as
unmatched; a licence that occurs several times is listed once; names are sorted; repeated rows are scanned one by one; scan() replaces
columns named sentence_ids, licenses or n_unmatched and keeps all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?]+[ \t]+|[.!?]*[\r\n]+"
# A sentence without any of these words is no licence sentence.
WORTH = r"licen|copyright|permission|redistribut|warrant|as is|spdx|public domain|gpl|\bcc\b|\bcc0\b|creative commons|misrepresented|altered"


def _versioned(names: list[str], versions: list[str]) -> list[str]:
    """Names with versions as they are written: `version 3`, `v3`, `3`, `3.0`, `3.0 only`, `3.0 or later`."""
    plain = [n + v for n in names for v in (f" {x}" for x in versions)]
    return plain + [f"{n} {w}{v}" for n in names for w in ("version ", "v") for v in versions] + [f"{n}v{v}" for n in names for v in versions]


def _gnu(long: str, short: str, version: str) -> list[str]:
    """Names of a GNU licence of a version."""
    whole = [version, version.replace(" 0", "")] if version.endswith(" 0") else [version]
    return _versioned([f"gnu {long}", long, f"gnu {short}", short], whole) + [f"gnu {long} as published by the free software foundation either version {v}" for v in whole]


def _cc(letters: str, words: str, version: str) -> list[str]:
    names = [f"cc {letters} {version}", f"creative commons {words} {version}", f"creative commons {letters} {version}"]
    return names + [f"{n} {more}" for n in names for more in ("international", "unported")]


# Identifier of the sentence, SPDX name, names in texts (normalised).
CATALOGUE: list[tuple[str, str, list[str]]] = [
    ("mit", "MIT", ["mit", "expat", "mit expat"]),
    ("mit0", "MIT-0", ["mit no attribution", "mit 0"]),
    ("apache2", "Apache-2.0", _versioned(["apache license", "apache", "apache software license", "asl"], ["2 0", "2"])),
    ("apache11", "Apache-1.1", _versioned(["apache license", "apache", "apache software license"], ["1 1"])),
    ("gpl3", "GPL-3.0", _gnu("general public license", "gpl", "3 0")),
    ("gpl2", "GPL-2.0", _gnu("general public license", "gpl", "2 0")),
    ("lgpl3", "LGPL-3.0", _gnu("lesser general public license", "lgpl", "3 0")),
    ("lgpl21", "LGPL-2.1", _gnu("lesser general public license", "lgpl", "2 1")),
    ("lgpl2", "LGPL-2.0", _gnu("library general public license", "lgpl", "2 0")),
    ("agpl3", "AGPL-3.0", _gnu("affero general public license", "agpl", "3 0")),
    ("bsd3", "BSD-3-Clause", ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd three clause"]),
    ("bsd2", "BSD-2-Clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd", "bsd two clause"]),
    ("bsd0", "0BSD", ["0bsd", "zero clause bsd", "bsd zero clause", "bsd 0 clause"]),
    ("bsd4", "BSD-4-Clause", ["bsd 4 clause", "4 clause bsd", "original bsd"]),
    ("isc", "ISC", ["isc"]),
    ("zlib", "Zlib", ["zlib", "zlib libpng"]),
    ("boost", "BSL-1.0", _versioned(["boost software license", "boost", "bsl"], ["1 0"])),
    ("busl", "BUSL-1.1", _versioned(["business source license", "busl"], ["1 1"])),
    ("mpl2", "MPL-2.0", _versioned(["mozilla public license", "mozilla", "mpl"], ["2 0", "2"])),
    ("mpl11", "MPL-1.1", _versioned(["mozilla public license", "mpl"], ["1 1"])),
    ("epl2", "EPL-2.0", _versioned(["eclipse public license", "epl"], ["2 0", "2"])),
    ("epl1", "EPL-1.0", _versioned(["eclipse public license", "epl"], ["1 0", "1"])),
    ("eupl12", "EUPL-1.2", _versioned(["european union public licence", "european union public license", "eupl"], ["1 2"])),
    ("cddl1", "CDDL-1.0", _versioned(["common development and distribution license", "cddl"], ["1 0"])),
    ("unlicense", "Unlicense", ["unlicense"]),
    ("wtfpl", "WTFPL", ["wtfpl"]),
    ("artistic2", "Artistic-2.0", _versioned(["artistic license", "artistic"], ["2 0"])),
    ("psf2", "PSF-2.0", _versioned(["python software foundation license", "psf license", "psf"], ["2", "2 0"])),
    ("upl1", "UPL-1.0", _versioned(["universal permissive license", "upl"], ["1 0"])),
    ("ms", "MS-PL", ["microsoft public", "ms pl"]),
    ("ofl11", "OFL-1.1", _versioned(["sil open font license", "open font license", "ofl"], ["1 1"])),
    ("sspl1", "SSPL-1.0", _versioned(["server side public license", "sspl"], ["1", "1 0"])),
    ("odbl1", "ODbL-1.0", _versioned(["open database license", "odbl"], ["1 0"])),
    ("cc0", "CC0-1.0", ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0", "creative commons zero v1 0 universal"]),
    ("ccby4", "CC-BY-4.0", _cc("by", "attribution", "4 0")),
    ("ccbysa4", "CC-BY-SA-4.0", _cc("by sa", "attribution sharealike", "4 0")),
    ("ccbysa3", "CC-BY-SA-3.0", _cc("by sa", "attribution sharealike", "3 0")),
    ("ccby3", "CC-BY-3.0", _cc("by", "attribution", "3 0")),
    ("ccbync4", "CC-BY-NC-4.0", _cc("by nc", "attribution noncommercial", "4 0")),
    ("ccbyncsa4", "CC-BY-NC-SA-4.0", _cc("by nc sa", "attribution noncommercial sharealike", "4 0")),
    ("ccbyncnd4", "CC-BY-NC-ND-4.0", _cc("by nc nd", "attribution noncommercial noderivatives", "4 0")),
    ("ccbynd4", "CC-BY-ND-4.0", _cc("by nd", "attribution noderivatives", "4 0")),
]
# Openings of licence sentences, and the identifiers that they stand for.
OPENINGS = {
    "permission is hereby granted free of charge to any person obtaining a copy": "grant",
    "the above copyright notice and this permission notice shall be included": "notice",
    "redistribution and use in source and binary forms": "redistribution",
    "redistributions of source code must retain": "source",
    "redistributions in binary form must reproduce": "binary",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "iscgrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "iscgrant",
    "permission is granted to anyone to use this software for any purpose including commercial applications": "zlibgrant",
    "the origin of this software must not be misrepresented": "zliborigin",
    "altered source versions must be plainly marked as such": "zlibaltered",
    "this notice may not be removed or altered from any source distribution": "zlibnotice",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation": "boost",
    "apache license version 2 0 january 2004": "apache2",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl",
}
# Licence, sequence of identifiers; ordered.
RULES = [
    ("BSD-3-Clause", ["redistribution", "source", "binary", "endorse", "asis"]),
    ("BSD-2-Clause", ["redistribution", "source", "binary", "asis"]),
    ("Zlib", ["asis", "zlibgrant", "zliborigin", "zlibaltered", "zlibnotice"]),
    ("Zlib", ["zlibgrant", "zliborigin", "zlibaltered", "zlibnotice"]),
    ("MIT", ["grant", "notice", "asis"]),
    ("ISC", ["iscgrant", "asis"]),
]
NAMED = {name: key for key, _, names in CATALOGUE for name in names}
LICENCE_OF = {key: spdx for key, spdx, _ in CATALOGUE}

# Names, longest first, so that of two that begin alike the longer one is taken.
_NAMES = "(?:" + "|".join(sorted(NAMED, key=lambda n: (-len(n), n))) + ")"
_VERBS = "(?:licensed|released|distributed|redistributed|available|published|provided|covered|issued|shared|offered)"
_GRANT = rf"(?:{_VERBS} (?:to you )?under|under the terms (?:and conditions )?of|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?{_NAMES}"
_BRANDED = rf"(?:is|are) {_NAMES} licen[cs]ed"
_TITLE = rf"^(?:the )?{_NAMES} licen[cs]e(?: agreement)?$|^(?:the )?(?:{'|'.join(sorted((n for n in NAMED if 'license' in n or 'licence' in n or n in ('unlicense', 'cc0 1 0 universal')), key=lambda n: (-len(n), n)))})(?: [0-9].*)?$"
_AS_IS = "(?:software|work|library|program) is provided (?:by .{1,200}? )?as is"
_ENDORSE = "(?:neither the names? of|nor the names of) .{1,300}? may be used to endorse"
_COPYRIGHT = "copyright (?:c )?[0-9]{4}"
_SPDX = "spdx license identifier [a-z0-9]"
#: All known sentences, in a normalised one.
KNOWN = rf"\b(?:{'|'.join(sorted(OPENINGS, key=lambda x: (-len(x), x)))}|{_GRANT}|{_BRANDED}|{_AS_IS}|{_ENDORSE}|{_COPYRIGHT})\b|\b{_SPDX}|{_TITLE}"
#: The name at the end of a grant or in a title.
NAME_IN = rf"\b({_NAMES})(?: licen[cs]ed?)?(?: agreement)?(?: [0-9].*)?$"

# A line end inside a sentence: the next line goes on in lower case, or the line is long, or a version below the title of a licence. Leading comment
# marks go. Blank lines, list items and short lines stay borders.
_BREAK = r"[ \t]*\r?\n[ \t]*(?:(?:\*|#+|//+|--|;+)[ \t]*)?"
_LAST = r"[\p{L}\p{N},)\"'’”-]"
WRAPS = [rf"({_LAST}){_BREAK}([\p{{Ll}}(\"“'`])", rf"([^\r\n]{{40}}{_LAST}){_BREAK}(\p{{Lu}})", rf"([Ll]icense|LICENSE){_BREAK}([Vv]ersion [0-9]|VERSION [0-9])"]
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n*]+)"
EXCEPTION, SPDX_NAME = r"(?i)\bWITH\s+\S+", r"[A-Za-z0-9][A-Za-z0-9.+-]*"

#: Stands for sentences that a rule has used.
USED = "|used|"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def identifier(match: Column) -> Column:
    """The identifier of what KNOWN has found."""
    named = F.coalesce(F.try_element_at(_map(OPENINGS), match), F.try_element_at(_map(NAMED), F.regexp_extract(match, NAME_IN, 1)))
    return F.when(match.rlike(" as is$"), "asis").when(match.rlike(" endorse$"), "endorse").when(match.rlike("^copyright "), "copyright").when(match.rlike("^spdx "), "spdx").otherwise(named)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (array, in order), licenses (sorted array) and n_unmatched."""
    body = F.coalesce(F.col(text), F.lit(""))
    whole = body
    for pattern in WRAPS:
        whole = F.regexp_replace(whole, pattern, "$1 $2")
    worth = F.filter(F.transform(F.split(whole, SENTENCE_END, -1), normalised), lambda s: s.rlike(WORTH))
    found = F.flatten(F.transform(worth, lambda s: F.regexp_extract_all(s, F.lit(KNOWN), F.lit(0))))
    ids = F.filter(F.transform(found, identifier), lambda x: x.isNotNull())
    # Most texts have no such word at all.
    rows = docs.withColumn("sentence_ids", F.when(body.rlike(f"(?i){WORTH}"), ids).otherwise(F.array().cast("array<string>")))
    # The sequence as one string of identifiers between bars; what a rule uses up becomes a mark that no rule has, so its neighbours don't meet.
    rows = rows.withColumn("__left", F.concat(F.lit("|"), F.array_join(F.transform("sentence_ids", lambda x: F.concat(x, F.lit("|"))), "|")))
    by_rule = []
    for i, (name, sequence) in enumerate(RULES):
        run = "|" + "||".join(sequence) + "|"
        rows = rows.withColumn(f"__rule{i}", F.when(F.contains("__left", F.lit(run)), name)).withColumn("__left", F.replace("__left", F.lit(run), F.lit(USED)))
        by_rule.append(f"__rule{i}")
    rows = rows.withColumn("__left", F.filter(F.split("__left", "[|]+"), lambda x: ~x.isin("", "used")))
    # Names of SPDX expressions, as they are written; an exception after WITH is no licence.
    told = F.transform(F.regexp_extract_all(body, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_extract_all(F.regexp_replace(x, EXCEPTION, ""), F.lit(SPDX_NAME), F.lit(0)))
    written = F.filter(F.flatten(told), lambda x: ~F.upper(x).isin("AND", "OR"))
    written = F.when(F.array_contains("sentence_ids", "spdx"), written).otherwise(F.array().cast("array<string>"))
    alone = F.transform("__left", lambda x: F.try_element_at(_map(LICENCE_OF), x))
    rows = rows.withColumn("licenses", F.array_sort(F.array_distinct(F.concat(F.array_compact(F.concat(F.array(*by_rule), alone)), written))))
    left = F.size(F.filter("__left", lambda x: ~x.isin("spdx", *LICENCE_OF)))
    return rows.withColumn("n_unmatched", left.cast("long")).drop("__left", *by_rule)


def op9(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_unmatched"
    )


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda values: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in values.items()) + "}"
    whole = "coalesce(text, '')"
    for pattern in WRAPS:
        whole = f"regexp_replace({whole}, {quoted(pattern)}, '\\1 \\2', 'g')"
    key = f"CASE WHEN m LIKE '% as is' THEN 'asis' WHEN m LIKE '% endorse' THEN 'endorse' WHEN m LIKE 'copyright %' THEN 'copyright' WHEN m LIKE 'spdx %' THEN 'spdx' ELSE coalesce({listed(OPENINGS)}[m], {listed(NAMED)}[regexp_extract(m, {quoted(NAME_IN)}, 1)]) END"
    left, names, steps = "run0", [], []
    for i, (name, sequence) in enumerate(RULES):
        run = "|" + "||".join(sequence) + "|"
        steps.append(f"s{i + 1} AS (SELECT *, CASE WHEN contains({left}, '{run}') THEN '{name}' END AS n{i}, replace({left}, '{run}', '{USED}') AS run{i + 1} FROM s{i})")
        left = f"run{i + 1}"
        names.append(f"n{i}")
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, list_filter(list_transform(regexp_split_to_array({whole}, '{SENTENCE_END}'), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: regexp_matches(x, '{WORTH}')) AS worth FROM documents),
named AS (SELECT doc_id, body, list_filter(list_transform(flatten(list_transform(CASE WHEN regexp_matches(body, '(?i){WORTH}') THEN worth ELSE [] END, lambda s: regexp_extract_all(s, {quoted(KNOWN)}))), lambda m: {key}), lambda x: x IS NOT NULL) AS ids FROM cut),
s0 AS (SELECT *, '|' || coalesce(array_to_string(list_transform(ids, lambda x: x || '|'), '|'), '') AS run0 FROM named),
{", ".join(steps)},
l AS (SELECT *, list_filter(regexp_split_to_array({left}, '[|]+'), lambda x: x NOT IN ('', 'used')) AS left_ids,
  CASE WHEN list_contains(ids, 'spdx') THEN list_filter(flatten(list_transform(regexp_extract_all(body, {quoted(SPDX)}, 1), lambda x: regexp_extract_all(regexp_replace(x, {quoted(EXCEPTION)}, '', 'g'), {quoted(SPDX_NAME)}))), lambda x: upper(x) NOT IN ('AND', 'OR')) ELSE [] END AS written FROM s{len(RULES)})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL), list_filter(list_transform(left_ids, lambda x: {listed(LICENCE_OF)}[x]), lambda x: x IS NOT NULL), written))), ','), '') AS licenses,
  CAST(len(list_filter(left_ids, lambda x: x <> 'spdx' AND {listed(LICENCE_OF)}[x] IS NULL)) AS BIGINT) AS n_unmatched
FROM l
"""


OP9_SQL = _sql()
