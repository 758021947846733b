"""Licence scans by sentence rules.  Native columns only.

A text is cut into sentences at ``.``, ``!``, ``?``, ``;`` or ``:`` with white space, at blank
lines (a bare comment mark is one), around SPDX lines, and before a line that begins like a
known sentence; any other line break only wraps a line.  Sentences are normalised: lower case,
ASCII letters and digits with one blank between, without list numbers, and with one form for
"this work is released under" and the like.  A sentence is known if its first three words are
in the dictionary and it begins with one of the openings listed there: licence sentences are
recognised, and sentences that only mention a licence are not.  The sequence of identifiers is
matched against ordered rules, the most specific first, and what a rule matched is taken out
before the next rule is tried.  Everything works within a row: no shuffle, no lookup table
that grows.

Defined cases: a null or empty text has no sentence and no licence; sentences that are not
known are skipped, so a known sequence may have other sentences between; a text may hold
several licences, listed once each in rule order; a known opening that goes on with words such
as "for evaluation only" is the sentence ``ALTERED``, for which there is no rule; "all rights reserved" counts only where no
other sentence is known; identifiers without a rule give ``UNMATCHED``; repeated rows are
scanned each; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GPL = "you can redistribute it and or modify it under the terms of the gnu general public license "
_LGPL = "you can redistribute it and or modify it under the terms of the gnu lesser general public license "
_AGPL = "you can redistribute it and or modify it under the terms of the gnu affero general public license "
_FSF = "as published by the free software foundation"

#: Fixed values: (identifier, opening of the normalised sentence, what it also holds).
SENTENCES = (
    ("SPDX_APACHE2", "spdx license identifier apache 2 0", ""),
    ("SPDX_MIT", "spdx license identifier mit", ""),
    ("SPDX_ISC", "spdx license identifier isc", ""),
    ("SPDX_BSD3", "spdx license identifier bsd 3 clause", ""),
    ("SPDX_BSD2", "spdx license identifier bsd 2 clause", ""),
    ("SPDX_GPL3", "spdx license identifier gpl 3 0", ""),
    ("SPDX_GPL2", "spdx license identifier gpl 2 0", ""),
    ("SPDX_LGPL3", "spdx license identifier lgpl 3 0", ""),
    ("SPDX_LGPL21", "spdx license identifier lgpl 2 1", ""),
    ("SPDX_AGPL3", "spdx license identifier agpl 3 0", ""),
    ("SPDX_MPL2", "spdx license identifier mpl 2 0", ""),
    ("SPDX_CC0", "spdx license identifier cc0 1 0", ""),
    ("SPDX_UNLICENSE", "spdx license identifier unlicense", ""),
    ("SPDX_GPL2_CLASSPATH", "spdx license identifier gpl 2 0 with classpath exception 2 0", ""),
    ("SPDX_GPL2_CLASSPATH", "spdx license identifier gpl 2 0 only with classpath exception 2 0", ""),
    ("SPDX_GPL2_CLASSPATH", "spdx license identifier gpl 2 0 orlater with classpath exception 2 0", ""),
    ("SPDX_GPL3_GCC", "spdx license identifier gpl 3 0 orlater with gcc exception 3 1", ""),
    ("SPDX_APACHE2_LLVM", "spdx license identifier apache 2 0 with llvm exception", ""),
    ("SPDX_BOOST", "spdx license identifier bsl 1 0", ""),
    ("SPDX_EPL2", "spdx license identifier epl 2 0", ""),
    ("SPDX_ZLIB", "spdx license identifier zlib", ""),
    ("SPDX_0BSD", "spdx license identifier 0bsd", ""),
    ("CC_BY_SA", "spdx license identifier cc by sa 4 0", ""),
    ("CC_BY", "spdx license identifier cc by 4 0", ""),
    ("CC_BY_SA_3", "spdx license identifier cc by sa 3 0", ""),
    ("CC_BY_3", "spdx license identifier cc by 3 0", ""),
    ("APACHE2_TITLE", "apache license version 2 0 january 2004", ""),
    ("GPL3_TITLE", "gnu general public license version 3 29 june 2007", ""),
    ("GPL2_TITLE", "gnu general public license version 2 june 1991", ""),
    ("LGPL3_TITLE", "gnu lesser general public license version 3 29 june 2007", ""),
    ("LGPL21_TITLE", "gnu lesser general public license version 2 1 february 1999", ""),
    ("AGPL3_TITLE", "gnu affero general public license version 3 19 november 2007", ""),
    ("MPL2_TITLE", "mozilla public license version 2 0", ""),
    ("EPL2_TITLE", "eclipse public license v 2 0", ""),
    ("BOOST_TITLE", "boost software license version 1 0 august 17th 2003", ""),
    ("BOOST_LINE", "licensed under the boost software license version 1 0", ""),
    ("BOOST_GRANT", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ""),
    ("EPL2_LINE", "this program and the accompanying materials are made available under the terms of the eclipse public license", "2 0"),
    ("ZLIB_GRANT", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ""),
    ("ZLIB_ASIS", "this software is provided as is without any express or implied warranty", ""),
    ("ZLIB_LINE", "licensed under the zlib license", ""),
    ("CC_BY_SA_3", "licensed under cc by sa 3 0", ""),
    ("CC_BY_3", "licensed under cc by 3 0", ""),
    ("CC_BY_SA_3", "licensed under a creative commons attribution sharealike 3 0", ""),
    ("CC_BY_3", "licensed under a creative commons attribution 3 0", ""),
    ("APACHE2_LINE", "licensed under the apache license version 2 0", ""),
    ("APACHE2_LINE", "the asf licenses this file to you under the apache license version 2 0", ""),
    ("APACHE2_COMPLY", "you may not use this file except in compliance with the license", ""),
    ("APACHE2_COPY", "you may obtain a copy of the license at", ""),
    ("APACHE2_ASIS", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", ""),
    ("MIT_LINE", "licensed under the mit license", ""),
    ("MIT_LINE", "licensed under the terms of the mit license", ""),
    ("MIT_GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("MIT_NOTICE", "the above copyright notice and this permission notice shall be included in all copies", ""),
    ("MIT_ASIS", "the software is provided as is without warranty of any kind", ""),
    ("ISC_LINE", "licensed under the isc license", ""),
    ("ISC_GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("ISC_GRANT", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ""),
    ("ISC_ASIS", "the software is provided as is and the author disclaims all warranties with regard to this software", ""),
    ("BSD_LINE", "licensed under the bsd license", ""),
    ("BSD_GRANT", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("BSD_SOURCE", "redistributions of source code must retain the above copyright notice", ""),
    ("BSD_BINARY", "redistributions in binary form must reproduce the above copyright notice", ""),
    ("BSD_NAME", "neither the name of", "may be used to endorse or promote products"),
    ("BSD_ASIS", "this software is provided by", "as is"),
    ("AGPL3_GRANT", _AGPL + _FSF + " either version 3", ""),
    ("AGPL3_LINE", "licensed under the gnu affero general public license", ""),
    ("LGPL3_GRANT", _LGPL + _FSF + " either version 3", ""),
    ("LGPL_GRANT", _LGPL + _FSF, ""),
    ("LGPL3_LINE", "licensed under the gnu lesser general public license version 3", ""),
    ("LGPL_LINE", "licensed under the gnu lesser general public license", ""),
    ("GPL3_GRANT", _GPL + _FSF + " either version 3", ""),
    ("GPL2_GRANT", _GPL + _FSF + " either version 2", ""),
    ("GPL2_GRANT", _GPL + "version 2 " + _FSF, ""),
    ("GPL3_GRANT", _GPL + "version 3 " + _FSF, ""),
    ("GPL_GRANT", _GPL + _FSF, ""),
    ("VERSION3", "either version 3 of the license", ""),
    ("VERSION2", "either version 2 of the license", ""),
    ("VERSION21", "either version 2 1 of the license", ""),
    ("GPL3_LINE", "licensed under the gnu general public license version 3", ""),
    ("GPL2_LINE", "licensed under the gnu general public license version 2", ""),
    ("GPL_ASIS", "this program is distributed in the hope that it will be useful", ""),
    ("MPL2_GRANT", "this source code form is subject to the terms of the mozilla public license v 2 0", ""),
    ("MPL2_COPY", "if a copy of the mpl was not distributed with this file you can obtain one at", ""),
    ("CC_BY_NC_SA", "licensed under cc by nc sa 4 0", ""),
    ("CC_BY_NC_ND", "licensed under cc by nc nd 4 0", ""),
    ("CC_BY_NC", "licensed under cc by nc 4 0", ""),
    ("CC_BY_SA", "licensed under cc by sa 4 0", ""),
    ("CC_BY_ND", "licensed under cc by nd 4 0", ""),
    ("CC_BY", "licensed under cc by 4 0", ""),
    ("CC_BY_NC_SA", "licensed under a creative commons attribution noncommercial sharealike 4 0", ""),
    ("CC_BY_NC_ND", "licensed under a creative commons attribution noncommercial noderivatives 4 0", ""),
    ("CC_BY_NC", "licensed under a creative commons attribution noncommercial 4 0", ""),
    ("CC_BY_SA", "licensed under a creative commons attribution sharealike 4 0", ""),
    ("CC_BY", "licensed under a creative commons attribution 4 0", ""),
    ("CC0", "licensed under cc0 1 0", ""),
    ("UNLICENSE_GRANT", "this is free and unencumbered software released into the public domain", ""),
    ("RESERVED", "all rights reserved", ""),
)

#: Fixed values: (licence, sequence of sentence identifiers), tried in this order.
RULES = (
    ("Apache-2.0", ("APACHE2_LINE", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_ASIS")),
    ("Apache-2.0", ("APACHE2_LINE",)),
    ("Apache-2.0", ("APACHE2_TITLE",)),
    ("Apache-2.0 WITH LLVM-exception", ("SPDX_APACHE2_LLVM",)),
    ("Apache-2.0", ("SPDX_APACHE2",)),
    ("BSL-1.0", ("BOOST_TITLE", "BOOST_GRANT")),
    ("BSL-1.0", ("BOOST_TITLE",)),
    ("BSL-1.0", ("BOOST_GRANT",)),
    ("BSL-1.0", ("BOOST_LINE",)),
    ("BSL-1.0", ("SPDX_BOOST",)),
    ("Zlib", ("ZLIB_ASIS", "ZLIB_GRANT")),
    ("Zlib", ("ZLIB_GRANT",)),
    ("Zlib", ("ZLIB_LINE",)),
    ("Zlib", ("SPDX_ZLIB",)),
    ("EPL-2.0", ("EPL2_TITLE",)),
    ("EPL-2.0", ("EPL2_LINE",)),
    ("EPL-2.0", ("SPDX_EPL2",)),
    ("0BSD", ("SPDX_0BSD",)),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_ASIS")),
    ("MIT", ("MIT_LINE",)),
    ("MIT", ("SPDX_MIT",)),
    ("ISC", ("ISC_GRANT", "ISC_ASIS")),
    ("ISC", ("ISC_GRANT",)),
    ("ISC", ("ISC_LINE",)),
    ("ISC", ("SPDX_ISC",)),
    ("BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAME", "BSD_ASIS")),
    ("BSD-3-Clause", ("SPDX_BSD3",)),
    ("BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ASIS")),
    ("BSD-2-Clause", ("SPDX_BSD2",)),
    ("BSD", ("BSD_LINE",)),
    ("AGPL-3.0", ("AGPL3_TITLE",)),
    ("LGPL-3.0", ("LGPL3_TITLE",)),
    ("LGPL-2.1", ("LGPL21_TITLE",)),
    ("GPL-3.0", ("GPL3_TITLE",)),
    ("GPL-2.0", ("GPL2_TITLE",)),
    ("MPL-2.0", ("MPL2_TITLE",)),
    ("GPL-2.0 WITH Classpath-exception-2.0", ("SPDX_GPL2_CLASSPATH",)),
    ("GPL-3.0 WITH GCC-exception-3.1", ("SPDX_GPL3_GCC",)),
    ("AGPL-3.0", ("AGPL3_GRANT", "GPL_ASIS")),
    ("AGPL-3.0", ("AGPL3_GRANT",)),
    ("AGPL-3.0", ("AGPL3_LINE",)),
    ("AGPL-3.0", ("SPDX_AGPL3",)),
    ("LGPL-3.0", ("LGPL3_GRANT", "GPL_ASIS")),
    ("LGPL-3.0", ("LGPL3_GRANT",)),
    ("LGPL-3.0", ("LGPL_GRANT", "VERSION3", "GPL_ASIS")),
    ("LGPL-3.0", ("LGPL3_LINE",)),
    ("LGPL-3.0", ("SPDX_LGPL3",)),
    ("LGPL-2.1", ("LGPL_GRANT", "VERSION21", "GPL_ASIS")),
    ("LGPL-2.1", ("LGPL_GRANT", "VERSION21")),
    ("LGPL-2.1", ("SPDX_LGPL21",)),
    ("LGPL", ("LGPL_GRANT",)),
    ("LGPL", ("LGPL_LINE",)),
    ("GPL-3.0", ("GPL3_GRANT", "GPL_ASIS")),
    ("GPL-3.0", ("GPL3_GRANT",)),
    ("GPL-3.0", ("GPL_GRANT", "VERSION3", "GPL_ASIS")),
    ("GPL-3.0", ("GPL_GRANT", "VERSION3")),
    ("GPL-3.0", ("GPL3_LINE",)),
    ("GPL-3.0", ("SPDX_GPL3",)),
    ("GPL-2.0", ("GPL2_GRANT", "GPL_ASIS")),
    ("GPL-2.0", ("GPL2_GRANT",)),
    ("GPL-2.0", ("GPL_GRANT", "VERSION2", "GPL_ASIS")),
    ("GPL-2.0", ("GPL_GRANT", "VERSION2")),
    ("GPL-2.0", ("GPL2_LINE",)),
    ("GPL-2.0", ("SPDX_GPL2",)),
    ("MPL-2.0", ("MPL2_GRANT", "MPL2_COPY")),
    ("MPL-2.0", ("MPL2_GRANT",)),
    ("MPL-2.0", ("SPDX_MPL2",)),
    ("CC-BY-NC-SA-4.0", ("CC_BY_NC_SA",)),
    ("CC-BY-NC-ND-4.0", ("CC_BY_NC_ND",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA",)),
    ("CC-BY-ND-4.0", ("CC_BY_ND",)),
    ("CC-BY-4.0", ("CC_BY",)),
    ("CC-BY-SA-3.0", ("CC_BY_SA_3",)),
    ("CC-BY-3.0", ("CC_BY_3",)),
    ("CC0-1.0", ("CC0",)),
    ("CC0-1.0", ("SPDX_CC0",)),
    ("Unlicense", ("UNLICENSE_GRANT",)),
    ("Unlicense", ("SPDX_UNLICENSE",)),
    ("Proprietary", ("RESERVED",)),
)

#: Words behind a known opening that turn its grant into another one.
_ALTERS = "(?:^| )(?:evaluation|non ?commercial|never|internal use|personal use|research purposes|academic use|educational use|not for|only for|for [a-z0-9 ]{1,40} only|in production|prohibited)(?: |$)"
_WORDS = 3
#: Sentence ends become this mark, which no lower-cased text holds.
_MARK = "S"
_ENDS = r"[.!?;:](?<!\b(?:inc|ltd|llc|corp|co|v)\.)(?<!identifier[;:])[^a-z0-9\s]*\s+|\.\s+(?=all rights reserved)|\n[^a-z0-9]*\n"
_SPDX = r"spdx-license-identifier:([^\n]*)"
#: A copyright line may run into the licence where lines were joined.
_LED = "^(?:.{1,200} )?copyright .{1,200}? (permission to use |permission is hereby granted |redistribution and use in )"
_UNDER = ("licensed", "released", "distributed", "made available", "available")


def _openers() -> str:
    """Pattern of the first words of known sentences."""
    gap = r"[^a-z0-9\n]+"
    known = sorted({gap.join(opening.split()[:_WORDS]) for name, opening, _ in SENTENCES if not name.endswith("_TITLE")})  # a name of a licence may begin any line of a sentence
    verbs = "|".join(_UNDER).replace(" ", gap)
    under = rf"(?:licensed|released|(?:this|the){gap}[a-z0-9]+{gap}is{gap}(?:{verbs})){gap}under"
    return "|".join((under, *known))


def _dictionary() -> Column:
    """First words -> openings that begin with them, longest first."""
    found: dict[str, list[tuple[str, str, str]]] = {}
    for name, opening, also in sorted(SENTENCES, key=lambda x: -len(x[1])):
        found.setdefault(" ".join(opening.split()[:_WORDS]), []).append((name, opening, also))
    entry = lambda e: F.struct(*(F.lit(v).alias(k) for v, k in zip(e, ("name", "opening", "also"), strict=True)))
    return F.create_map(*(c for key, entries in found.items() for c in (F.lit(key), F.array(*map(entry, entries)))))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text."""
    low = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\r\n?", "\n")
    low = F.when(F.contains(low, F.lit("spdx-license-identifier:")), F.regexp_replace(low, _SPDX, f"{_MARK}spdx license identifier$1{_MARK}")).otherwise(low)
    cut = F.regexp_replace(F.regexp_replace(low, _ENDS, _MARK), rf"\n([^a-z0-9\n{_MARK}]*(?:{_openers()}))", f"{_MARK}$1")
    return F.transform(F.split(F.regexp_replace(cut, f"[^a-z0-9{_MARK}]+", " "), _MARK), lambda s: F.trim(s))


def sentence_id(sentence: Column) -> Column:
    """Identifier of a known normalised sentence, else null."""
    plain = F.regexp_replace(sentence, "^(?:[0-9]+ )?(?:[a-c] )?(redistributions|neither) ", "$1 ")
    plain = F.regexp_replace(plain, f"^(?:(?:this|the) [a-z0-9]+ is )?(?:{'|'.join(_UNDER)}) under ", "licensed under ")
    plain = F.regexp_replace(plain, _LED, "$1")
    plain = F.regexp_replace(plain, "^.{1,80} is distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful")
    listed = F.try_element_at(_dictionary(), F.substring_index(plain, " ", _WORDS))
    fits = F.filter(listed, lambda e: ((plain == e["opening"]) | F.startswith(plain, F.concat(e["opening"], F.lit(" ")))) & F.contains(plain, e["also"]))
    found = F.get(fits, 0)
    altered = F.substring(plain, F.length(found["opening"]) + 1, F.length(plain)).rlike(_ALTERS)
    return F.when(altered, F.lit("ALTERED")).otherwise(found["name"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licence_sentences, sentence_ids, licences of every row."""
    each = F.filter(sentences(F.col("text")), lambda s: s.rlike(_HINT))
    # an SPDX expression names several licences; "or later" is part of one
    spdx = "spdx license identifier "
    parts = lambda s: F.transform(F.split(F.replace(F.substring(s, len(spdx) + 1, 1 << 30), F.lit(" or later"), F.lit(" orlater")), " (?:or|and) "), lambda p: F.concat(F.lit(spdx), p))
    each = F.flatten(F.transform(each, lambda s: F.when(F.startswith(s, F.lit(spdx)), parts(s)).otherwise(F.array(s))))
    ids = F.filter(F.transform(each, sentence_id), lambda x: x.isNotNull())
    rows = docs.select("doc_id", ids.alias("ids"))
    others = F.filter("ids", lambda x: x != "RESERVED")
    rows = rows.select("doc_id", F.when(F.size(others) > 0, others).otherwise(F.col("ids")).alias("ids"))
    rows = rows.select("doc_id", "ids", F.concat(F.lit(" "), F.array_join(F.transform("ids", lambda s: F.concat(s, F.lit(" "))), " ")).alias("left_0"))
    # an identifier is " ID "; a rule removes its sequence wherever it stands
    columns, left = [], F.col("left_0")
    for name, sequence in RULES:
        mark = F.lit(" " + "  ".join(sequence) + " ")
        columns.append(F.when(F.contains(left, mark), F.lit(name)))
        left = F.replace(left, mark, F.lit(" "))
    columns.append(F.when((F.size("ids") > 0) & (F.trim(left) != ""), F.lit("UNMATCHED")))
    licences = F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    licences = F.when(F.size("ids") > 0, licences).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_licence_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join(licences, ",").alias("licences"))


#: No known sentence is without one of these.
_HINT = "licens|licence|copyright|redistribut|warrant|permission|provided|public domain|rights reserved|endorse|useful|mpl"


def oracle_sql() -> str:
    """The same scan in DuckDB SQL: every sentence against every opening, the longest one counts."""
    openings = ", ".join(f"('{n}', '{o}', '{a}')" for n, o, a in SENTENCES)
    under = "|".join(_UNDER)
    steps, marks, left = [], {}, "seq"
    for k, (name, sequence) in enumerate(RULES):
        mark = " " + "  ".join(sequence) + " "
        steps.append(f"s{k} AS (SELECT *, contains({left}, '{mark}') AS h{k}, replace({left}, '{mark}', ' ') AS l{k} FROM {'q' if not k else f's{k - 1}'})")
        marks.setdefault(name, []).append(f"h{k}")
        left = f"l{k}"
    flags = ", ".join(f"CASE WHEN {' OR '.join(hits)} THEN '{name}' END" for name, hits in marks.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(replace(lower(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
a AS (SELECT r, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\.\s+(all rights reserved)', 'S\1', 'g'), 'spdx-license-identifier:([^\n]*)', 'Sspdx license identifier\1S', 'g'), '\b(inc|ltd|llc|corp|co|v)\.', '\1 ', 'g'), 'identifier[;:]', 'identifier ', 'g') AS t FROM d),
b AS (SELECT r, regexp_replace(regexp_replace(t, '[.!?;:][^a-z0-9\s]*\s+|\n[^a-z0-9]*\n', 'S', 'g'), '\n([^a-z0-9\nS]*(?:{_openers()}))', 'S\1', 'g') AS t FROM a),
u AS (SELECT r, generate_subscripts(string_split(t, 'S'), 1) AS i, trim(regexp_replace(unnest(string_split(t, 'S')), '[^a-z0-9]+', ' ', 'g')) AS s FROM b),
v AS (SELECT r, i, generate_subscripts(p, 1) AS j, unnest(p) AS s FROM (SELECT r, i, CASE WHEN starts_with(s, 'spdx license identifier ')
  THEN list_transform(string_split_regex(replace(substr(s, 25), ' or later', ' orlater'), ' (?:or|and) '), lambda x: 'spdx license identifier ' || x) ELSE [s] END AS p FROM u WHERE s <> '')),
w AS (SELECT r, i, j, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^(?:[0-9]+ )?(?:[a-c] )?(redistributions|neither) ', '\1 '), '^(?:(?:this|the) [a-z0-9]+ is )?(?:{under}) under ', 'licensed under '), '{_LED}', '\1'),
  '^.{{1,80}} is distributed in the hope that it will be useful', 'this program is distributed in the hope that it will be useful') AS s FROM v WHERE regexp_matches(s, '{_HINT}')),
o(name, opening, also) AS (VALUES {openings}),
m AS (SELECT w.r, w.i, w.j, max_by(CASE WHEN regexp_matches(substr(w.s, length(o.opening) + 1), '{_ALTERS}') THEN 'ALTERED' ELSE o.name END, length(o.opening)) AS name FROM w JOIN o ON (w.s = o.opening OR starts_with(w.s, o.opening || ' ')) AND contains(w.s, o.also) GROUP BY ALL),
c AS (SELECT r, list(name ORDER BY i, j) AS every FROM m GROUP BY r),
e AS (SELECT r, CASE WHEN len(list_filter(every, lambda x: x <> 'RESERVED')) > 0 THEN list_filter(every, lambda x: x <> 'RESERVED') ELSE every END AS ids FROM c),
q AS (SELECT d.doc_id, coalesce(e.ids, []) AS ids, ' ' || array_to_string(list_transform(coalesce(e.ids, []), lambda x: x || ' '), ' ') AS seq FROM d LEFT JOIN e USING (r)),
{", ".join(steps)}
SELECT doc_id, len(ids) AS n_licence_sentences, array_to_string(ids, ' ') AS sentence_ids,
  concat_ws(',', {flags}, CASE WHEN len(ids) > 0 AND trim({left}) <> '' THEN 'UNMATCHED' END) AS licences
FROM s{len(RULES) - 1}
"""
