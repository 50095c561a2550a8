"""License scans by sentence rules.

Texts are cut into sentences, sentences are normalised (lower case, words of
letters and digits only), and those in a catalogue of licence sentences give
a sequence of identifiers.  An ordered rule names a licence by identifiers
that must come in its order; other licence sentences may stand between them.
Line ends are read both ways, as ends of sentences and (but for blank lines)
as spaces, since licence texts are often wrapped; a rule may match in either
reading.  Beside the catalogue, three forms are read by pattern: a sentence
that is a notice ("This project is licensed under the ...") or title with one
of ``license_names.NAMES``, the GNU headers and the titles of full texts with
their version, and SPDX lines with any identifier (all of an expression, the
exceptions left out).  Only DataFrame functions are used.

Defined cases: a null or empty text has no sentences and no licences;
repeated rows are scanned as rows of their own; an empty table gives an empty
result; other columns pass unchanged.

Scale: map-only, no shuffle and no state beyond one text.  The catalogue and
the names are fixed tables, part of the plan; sentences meet the catalogue by
a hash.
"""

from __future__ import annotations

import re
import zlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm.license_names import NAMES, SPDX_SPELT, SPDX_WORDS
from conceptsearch.llm.tables import fresh

# Licence sentences (as cut at sentence ends), by identifier,
# and the rules, each an ordered sequence of identifiers.
SENTENCES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-name": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-terms": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0",
    "cc0-notice": "Licensed under CC0 1.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "reserved": "All rights reserved",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}
RULES = (
    ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)), ("MIT", ("spdx-mit",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", ("apache-notice",)), ("Apache-2.0", ("spdx-apache",)),
    ("Apache-2.0", ("apache-terms", "apache-use", "apache-copy", "apache-basis")),
    ("GPL-3.0", ("gpl3-notice",)), ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-copy")),
    ("GPL-2.0", ("gpl2-notice",)),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-name")), ("BSD-3-Clause", ("spdx-bsd3",)),
    ("CC-BY-4.0", ("cc-by-notice",)), ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)), ("CC-BY-ND-4.0", ("cc-by-nd-notice",)), ("CC0-1.0", ("cc0-notice",)),
    ("all-rights-reserved", ("reserved",)),
    ("MIT", ("mit-name",)), ("GPL-3.0-or-later", ("gpl-free",)), ("MPL-2.0", ("mpl-form",)),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-grant-2",)), ("0BSD", ("0bsd-grant",)), ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-warranty", "zlib-altered")), ("Zlib", ("zlib-warranty", "zlib-origin")), ("BSL-1.0", ("boost-grant",)),
)
#: A licence that another one on the same text includes is not reported.
INCLUDED = {"BSD-2-Clause": "BSD-3-Clause"}

# No pattern repeats a group that can give back: such loops recurse once for
# each turn, and end the executor on a long text.
_END = "(?<![.!?;])[.!?;]++(?=\\s|$)"
_OTHER = "[^\\p{L}\\p{M}\\p{N}\u0001\n]+"


def normalised(sentence: str) -> str:
    """A sentence of the catalogue, as texts' sentences are normalised."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip()


def _slots() -> list[str]:
    """The catalogue's sentences, each at its crc32 modulo the list's length."""
    known = list(dict.fromkeys(normalised(s) for s in SENTENCES.values()))
    for size in count(len(known)):
        at = {zlib.crc32(s.encode()) % size: s for s in known}
        if len(at) == len(known):
            return [at.get(k, "") for k in range(size)]


def _identifiers(sentences: Column) -> Column:
    """Catalogue numbers of the sentences that are in it, in text order."""
    known = F.split(F.lit("\n".join(normalised(s) for s in SENTENCES.values())), "\n")
    table = _slots()
    slots = F.split(F.lit("\n".join(table)), "\n")
    found = F.filter(sentences, lambda s: (s != "") & (F.get(slots, (F.crc32(s.cast("binary")) % len(table)).cast("int")) == s))
    return F.transform(found, lambda s: F.array_position(known, s).cast("int"))


_VERBS = "licensed|released|distributed|published|available|made available|provided|covered|offered"
_NOTICE = (f"^(?:[a-z0-9 ]{{1,60}} (?<!not )(?:is|are) )?(?:(?:free software|open source) )?(?:{_VERBS}) (?:for use )?"
           "under (?:the )?(?:terms of )?(?:the )?(?:conditions of the )?(.+?)$")
_SPDX_ID = "[A-Za-z0-9]++(?:[.:+-]++[A-Za-z0-9]++)*+[+]?"
_SPDX = ("(?i)SPDX-License-Identifier:[ \\t]*([( \\t]*" + _SPDX_ID
         + "(?:[) \\t]*[ \\t)](?:and|or|with)[ \\t(][( \\t]*" + _SPDX_ID + ")*+)")
_GNU = ("gnu (lesser |library |affero )?general public license (?:as published by the free software foundation )?(?:either )?"
        "(?:version |v)([0-9])(?: ([0-9])(?![0-9]))?(?: of the license)?(?: as published by the free software foundation)?"
        "( or at your option any later version| or later)?")
#: What must stand before a GNU name with its version, and after it in titles.
_GNU_HEADER, _GNU_TITLE = f"under the terms of the {_GNU}", f"{_GNU} (?:[0-9]+ )?(?:june|november|february) (?:1989|1991|1999|2007)"
_APACHE_TITLE = "apache license version 2 0 january 2004"
_BSD_NAME = "neither the names? of .{1,200}? nor the names of (?:its|their|other|any) contributors may be used to endorse or promote"


def _noticed(sentences: Column) -> Column:
    """Licences of the sentences that are a notice or a title."""
    names = F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in NAMES.items())), F.lit("\n"), F.lit("="))
    likely = F.filter(sentences, lambda s: F.contains(s, F.lit("under ")) | F.contains(s, F.lit("licen")))
    keys = F.transform(likely, lambda s: F.when(s.rlike(_NOTICE), F.regexp_extract(s, _NOTICE, 1))
                       .when(F.contains(s, F.lit("licen")), F.regexp_replace(s, "^the ", "")))
    return F.transform(F.array_compact(keys), lambda k: F.try_element_at(names, k))


def _gnu_names(plain: Column) -> Column:
    """GNU licences that headers and titles of full texts name."""
    def name(m: Column) -> Column:
        kind = F.regexp_extract(m, _GNU, 1)
        short = F.when(kind == "affero ", "AGPL").when(kind == "", "GPL").otherwise("LGPL")
        minor = F.regexp_extract(m, _GNU, 3)
        return F.concat(short, F.lit("-"), F.regexp_extract(m, _GNU, 2), F.lit("."), F.when(minor == "", "0").otherwise(minor),
                        F.when(F.regexp_extract(m, _GNU, 4) == "", "").otherwise("-or-later"))

    return F.concat(*(F.transform(F.regexp_extract_all(plain, F.lit(p), F.lit(0)), name) for p in (_GNU_HEADER, _GNU_TITLE)))


def _spdx_names(text: Column) -> Column:
    """Licences of SPDX lines; "-only" is left out as in the rules, "+" is or-later."""
    spelt = F.str_to_map(F.lit("\n".join(f"{k}={v}" for k, v in SPDX_SPELT.items())), F.lit("\n"), F.lit("="))
    words = "|".join(w.lower() for w in SPDX_WORDS)
    listed = F.transform(F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1)), lambda e: F.split(F.regexp_replace(
        e, f"(?i)[ \\t)]with[ \\t(][( \\t]*{_SPDX_ID}", " "), "(?i)(?:[ \\t()]+(?:and|or)(?=[ \\t(]))?[ \\t()]+"))
    each = F.filter(F.flatten(listed), lambda x: x.rlike(f"(?i)[0-9-]|^(?:{words})[+]?$"))
    plain = F.transform(each, lambda x: F.regexp_replace(F.regexp_replace(x, "[+]$", "-or-later"), "(?i)-only$", ""))
    later = F.transform(plain, lambda x: F.regexp_replace(x, "(?i)-or-later$", ""))
    return F.transform(F.arrays_zip(plain.alias("full"), later.alias("base")), lambda x: F.concat(
        F.coalesce(F.try_element_at(spelt, F.lower(x["base"])), x["base"]),
        F.when(F.lower(x["full"]).endswith("-or-later"), "-or-later").otherwise("")))


def _matches(ids: Column, sequence: tuple[str, ...]) -> Column:
    """Whether the rule's identifiers come in their order: one pass that waits
    for the next of them."""
    numbers = [list(SENTENCES).index(s) + 1 for s in sequence]
    if len(numbers) == 1:
        return F.array_contains(ids, numbers[0])
    wanted = F.array(*map(F.lit, numbers))
    return F.aggregate(ids, F.lit(0), lambda k, x: F.when(F.get(wanted, k) == x, k + 1).otherwise(k)) == len(numbers)


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with sentence_ids (of the reading by lines), wrapped_ids (of
    the other), licenses (sorted); and the names these columns got."""
    names = dict(zip(("sentence_ids", "wrapped_ids", "licenses"), fresh(docs, "sentence_ids", "wrapped_ids", "licenses"),
                     strict=True))
    flat, by_line, by_wrap = fresh(docs, "flat", "by_line", "by_wrap")
    marked = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), _END, "\u0001")
    out = docs.withColumn(flat, F.regexp_replace(marked, _OTHER, " "))
    wrapped = F.translate(F.regexp_replace(F.col(flat), "\n *\n", "\u0001"), "\n", " ")
    wrapped = F.regexp_replace(wrapped, " {2,}", " ")
    out = out.withColumns({by_line: F.transform(F.split(F.col(flat), "[\n\u0001]"), lambda s: F.trim(s)),
                           by_wrap: F.transform(F.split(wrapped, "\u0001"), lambda s: F.trim(s))})
    out = out.withColumns({names["sentence_ids"]: _identifiers(F.col(by_line)), names["wrapped_ids"]: _identifiers(F.col(by_wrap))})
    readings = [F.col(names[k]) for k in ("sentence_ids", "wrapped_ids")]
    matched = F.array_compact(F.array(*(
        F.when(_matches(readings[0], seq) | _matches(readings[1], seq), F.lit(name)) for name, seq in RULES)))
    plain = F.regexp_replace(F.col(flat), "[ \n\u0001]+", " ")
    none = F.array().cast("array<string>")
    raw = F.coalesce(F.col(text), F.lit(""))
    matched = F.concat(
        F.when((F.size(names["sentence_ids"]) > 0) | (F.size(names["wrapped_ids"]) > 0), matched).otherwise(none),
        _noticed(F.col(by_line)), _noticed(F.col(by_wrap)),
        F.when(F.contains(F.col(flat), F.lit("gnu")), _gnu_names(plain)).otherwise(none),
        F.when(F.contains(F.col(flat), F.lit("january 2004")) & F.contains(plain, F.lit(_APACHE_TITLE)),
               F.array(F.lit("Apache-2.0"))).otherwise(none),
        F.when(F.contains(F.col(flat), F.lit("spdx")), _spdx_names(raw)).otherwise(none))
    licenses = F.array_sort(F.array_distinct(F.array_compact(matched)))
    licenses = F.when(F.array_contains(licenses, "BSD-2-Clause") & plain.rlike(_BSD_NAME),
                      F.array_sort(F.array_union(licenses, F.array(F.lit("BSD-3-Clause"))))).otherwise(licenses)
    out = out.withColumn(names["licenses"], licenses).drop(flat, by_line, by_wrap)
    licenses = F.col(names["licenses"])
    for less, more in INCLUDED.items():
        licenses = F.when(F.array_contains(licenses, more), F.array_remove(licenses, less)).otherwise(licenses)
    return out.withColumn(names["licenses"], licenses), names


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (catalogue sentences found by lines), licenses
    (comma-joined names) of every row."""
    out, _ = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("sentences"),
                      F.array_join("licenses", ",").alias("licenses"))
