"""Licence scans by sentence rules, in DataFrame expressions only.

A text is unwrapped and cut into sentences; a sentence in its normal form (lower case, runs of anything but
letters and digits as one space) is looked up among known licence sentences, which gives the text's sequence
of sentence identifiers. Ordered rules are sequences of identifiers, the longest first; what a rule has
matched is used up, so a licence's notice inside its full text is not counted again. Up to ``GAP`` unknown
sentences may stand between two of a rule.

Scale: everything happens inside the row, so nothing is shuffled and no key can be hot; texts without any of
``MARKERS`` are not cut up at all (every known sentence has one).

Edge cases: a null or empty text has no sentences and no licence. Repeated rows each get their result.
Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2
MARKERS = ("licen", "copyright", "reserved", "permi", "warrant", "redistribut", "domain", "liab", "the mpl ")

# Sentences of public licences and of usual notices, in normal form, by identifier.
SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.title": "the mit license mit",
    "mit.short-title": "mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache.licensed": "licensed under the apache license version 2 0",
    "apache.the-license": "licensed under the apache license version 2 0 the license",
    "apache.title": "apache license version 2 0",
    "apache.compliance": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache.copy-https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache.as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.work": "this work is licensed under the gnu general public license version 3",
    "gpl3.licensed": "licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.details": "see the gnu general public license for more details",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl2.licensed": "licensed under the gnu general public license version 2",
    "lgpl3.licensed": "licensed under the gnu lesser general public license version 3",
    "agpl3.licensed": "licensed under the gnu affero general public license version 3",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense.domain": "this is free and unencumbered software released into the public domain",
    "cc0.licensed": "licensed under cc0 1 0",
    "cc0.work": "this work is dedicated to the public domain under cc0 1 0",
    "ccby.licensed": "licensed under cc by 4 0",
    "ccby.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa.licensed": "licensed under cc by sa 4 0",
    "ccbysa.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync.licensed": "licensed under cc by nc 4 0",
    "ccbync.work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccbynd.licensed": "licensed under cc by nd 4 0",
    "ccbyncsa.licensed": "licensed under cc by nc sa 4 0",
    "ccbynd.work": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "ccbyncsa.work": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "apache.copy-at": "you may obtain a copy of the license at",
    "apache.url": "http www apache org licenses license 2 0",
    "apache.url-https": "https www apache org licenses license 2 0",
    "apache.full-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache.full-license": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache.full-licensor": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "apache.full-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gpl3.full-title": "gnu general public license version 3 29 june 2007",
    "gpl3.full-free": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl3.full-designed": "the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
    "gpl3.full-contrast": "by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users",
    "gpl2.full-title": "gnu general public license version 2 june 1991",
    "gpl2.full-designed": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl2.full-contrast": "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    "lgpl3.full-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl3.full-incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "lgpl3.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21.full-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl21.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.details": "see the gnu lesser general public license for more details",
    "agpl3.full-title": "gnu affero general public license version 3 19 november 2007",
    "agpl3.full-free": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "agpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3.details": "see the gnu affero general public license for more details",
    "mpl2.full-title": "mozilla public license version 2 0",
    "mpl2.obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl2.obtain-http": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl2.notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "zlib.as-is": "this software is provided as is without any express or implied warranty",
    "zlib.liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl.title": "boost software license version 1 0 august 17th 2003",
    "bsl.notice": "distributed under the boost software license version 1 0",
    "wtfpl.title": "do what the fuck you want to public license",
    "isc.as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ccby.full-bound": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license public license",
    "ccbysa.full-bound": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license public license",
    "ccbync.full-bound": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license public license",
    "ccbynd.full-bound": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license public license",
    "ccbyncsa.full-bound": "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license public license",
    "arr.reserved": "all rights reserved",
    "arr.no-copy": "no part of this publication may be reproduced without the prior written permission of the publisher",
}

# Fixed values: (licence, sequence of identifiers), for each licence its full texts and its notices.
RULES = (
    ("MIT", ("mit.grant", "mit.notice", "mit.as-is", "mit.liability")),
    ("MIT", ("mit.title", "mit.grant", "mit.notice", "mit.as-is", "mit.liability")),
    ("MIT", ("mit.short-title", "mit.grant", "mit.notice", "mit.as-is", "mit.liability")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("MIT", ("mit.grant",)),
    ("MIT", ("mit.released",)),
    ("MIT", ("mit.licensed",)),
    ("MIT", ("mit.title",)),
    ("MIT", ("mit.short-title",)),
    ("Apache-2.0", ("apache.the-license", "apache.compliance", "apache.copy", "apache.as-is", "apache.see")),
    ("Apache-2.0", ("apache.the-license", "apache.compliance", "apache.copy-https", "apache.as-is", "apache.see")),
    ("Apache-2.0", ("apache.the-license", "apache.compliance")),
    ("Apache-2.0", ("apache.the-license",)),
    ("Apache-2.0", ("apache.licensed",)),
    ("Apache-2.0", ("apache.title",)),
    ("GPL-3.0", ("gpl.free", "gpl.hope", "gpl.details")),
    ("GPL-3.0", ("gpl.free",)),
    ("GPL-3.0", ("gpl3.work",)),
    ("GPL-3.0", ("gpl3.licensed",)),
    ("GPL-2.0", ("gpl2.free", "gpl.hope", "gpl.details")),
    ("GPL-2.0", ("gpl2.free",)),
    ("GPL-2.0", ("gpl2.licensed",)),
    ("LGPL-3.0", ("lgpl3.licensed",)),
    ("AGPL-3.0", ("agpl3.licensed",)),
    ("MPL-2.0", ("mpl2.notice",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.as-is")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.as-is")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("ISC", ("isc.grant", "mit.as-is")),
    ("ISC", ("isc.grant",)),
    ("Unlicense", ("unlicense.domain",)),
    ("CC0-1.0", ("cc0.licensed",)),
    ("CC0-1.0", ("cc0.work",)),
    ("CC-BY-4.0", ("ccby.licensed",)),
    ("CC-BY-4.0", ("ccby.work",)),
    ("CC-BY-SA-4.0", ("ccbysa.licensed",)),
    ("CC-BY-SA-4.0", ("ccbysa.work",)),
    ("CC-BY-NC-4.0", ("ccbync.licensed",)),
    ("CC-BY-NC-4.0", ("ccbync.work",)),
    ("CC-BY-ND-4.0", ("ccbynd.licensed",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa.licensed",)),
    ("CC-BY-ND-4.0", ("ccbynd.work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa.work",)),
    ("Apache-2.0", ("apache.the-license", "apache.compliance", "apache.copy-at", "apache.url", "apache.as-is", "apache.see")),
    ("Apache-2.0", ("apache.the-license", "apache.compliance", "apache.copy-at", "apache.url-https", "apache.as-is", "apache.see")),
    ("Apache-2.0", ("apache.full-title", "apache.full-license", "apache.full-licensor")),
    ("Apache-2.0", ("apache.full-license", "apache.full-licensor")),
    ("Apache-2.0", ("apache.full-title",)),
    ("Apache-2.0", ("apache.full-grant",)),
    ("GPL-3.0", ("gpl3.full-free", "gpl3.full-designed", "gpl3.full-contrast")),
    ("GPL-3.0", ("gpl3.full-title",)),
    ("GPL-3.0", ("gpl3.full-free",)),
    ("GPL-2.0", ("gpl2.full-designed", "gpl2.full-contrast")),
    ("GPL-2.0", ("gpl2.full-title",)),
    ("GPL-2.0", ("gpl2.full-designed",)),
    ("LGPL-3.0", ("lgpl3.free", "lgpl.hope", "lgpl.details")),
    ("LGPL-3.0", ("lgpl3.free",)),
    ("LGPL-3.0", ("lgpl3.full-title",)),
    ("LGPL-3.0", ("lgpl3.full-incorporates",)),
    ("LGPL-2.1", ("lgpl21.free", "lgpl.hope", "lgpl.details")),
    ("LGPL-2.1", ("lgpl21.free",)),
    ("LGPL-2.1", ("lgpl21.full-title",)),
    ("AGPL-3.0", ("agpl3.free", "gpl.hope", "agpl3.details")),
    ("AGPL-3.0", ("agpl3.free",)),
    ("AGPL-3.0", ("agpl3.full-title",)),
    ("AGPL-3.0", ("agpl3.full-free",)),
    ("MPL-2.0", ("mpl2.notice", "mpl2.obtain")),
    ("MPL-2.0", ("mpl2.notice", "mpl2.obtain-http")),
    ("MPL-2.0", ("mpl2.full-title",)),
    ("EPL-2.0", ("epl2.notice",)),
    ("Zlib", ("zlib.as-is", "zlib.liable", "zlib.grant")),
    ("Zlib", ("zlib.grant",)),
    ("BSL-1.0", ("bsl.title",)),
    ("BSL-1.0", ("bsl.notice",)),
    ("WTFPL", ("wtfpl.title",)),
    ("ISC", ("isc.grant", "isc.as-is")),
    ("CC-BY-4.0", ("ccby.full-bound",)),
    ("CC-BY-SA-4.0", ("ccbysa.full-bound",)),
    ("CC-BY-NC-4.0", ("ccbync.full-bound",)),
    ("CC-BY-ND-4.0", ("ccbynd.full-bound",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa.full-bound",)),
    ("All-Rights-Reserved", ("arr.no-copy", "arr.reserved")),
    ("All-Rights-Reserved", ("arr.reserved",)),
    ("All-Rights-Reserved", ("arr.no-copy",)),
)

# The identifiers that may stand after "SPDX-License-Identifier:", by licence.
SPDX = {
    "MIT": ("MIT",),
    "Apache-2.0": ("Apache-2.0",),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0 WITH Linux-syscall-note"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "MPL-2.0": ("MPL-2.0",),
    "EPL-2.0": ("EPL-2.0",),
    "BSD-3-Clause": ("BSD-3-Clause",),
    "BSD-2-Clause": ("BSD-2-Clause",),
    "ISC": ("ISC",),
    "Zlib": ("Zlib",),
    "BSL-1.0": ("BSL-1.0",),
    "WTFPL": ("WTFPL",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0-1.0",),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0",),
    "CC-BY-NC-SA-4.0": ("CC-BY-NC-SA-4.0",),
}


def _spdx() -> dict[str, tuple[str, str]]:
    """(licence, sentence) of each SPDX line by its sentence's identifier."""
    return {f"spdx.{i.lower().replace(' ', '-')}": (name, "spdx license identifier " + re.sub("[^a-z0-9]+", " ", i.lower())) for name, ids in SPDX.items() for i in ids}


SENTENCES |= {k: s for k, (_, s) in _spdx().items()}
RULES += tuple((name, (k,)) for k, (name, _) in _spdx().items())

#: The first class of which a text has a licence is the text's class.
CLASSES = (
    ("restricted", ("All-Rights-Reserved", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0")),
    ("copyleft", ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC-BY-SA-4.0")),
    ("permissive", ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Zlib", "BSL-1.0", "WTFPL", "Unlicense", "CC0-1.0", "CC-BY-4.0")),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, replacement): comment signs at a line's start; an SPDX line, which ends with its line; wrapped lines, in small letters, before a word of a licence's name,
#: or in capitals; the end of a sentence, which is not before a number ("v. 2.0").
STEPS = (
    (r"(^|\n)[ \t]*(?:#+|//+|\*+|;+|--+)[ \t]*", "\n"),
    (r"(SPDX-License-Identifier:[^\r\n*]*)[^\r\n]*\r?\n", "{1}.\n"),
    (r"([a-z0-9,(])[ \t]*\r?\n[ \t]*([a-z0-9(])", "{1} {2}"),
    (r"([A-Za-z,])[ \t]*\r?\n[ \t]*(License|General|Public|Lesser|Affero|Foundation|Software|Version|GNU|Mozilla|Apache|MERCHANTABILITY|FITNESS|WARRANTY)", "{1} {2}"),
    (r"([A-Z][,)\"]*)[ \t]*\r?\n[ \t]*([(\"]?[A-Z]{2})", "{1} {2}"),
    (r"([.!?])[ \t\r\f]+([^0-9])", "{1}\n{2}"),
)


def patterns(rules=RULES) -> list[tuple[str, str]]:
    """(licence, its sequence as a string), the longest sequences first."""
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in sorted(rules, key=lambda r: -len(r[1]))]


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form, without empty ones."""
    for pattern, to in STEPS:
        text = F.regexp_replace(text, pattern, to.replace("{", "$").replace("}", ""))
    normal = F.transform(F.split(F.translate(text, _UPPER, _LOWER), "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    return F.filter(normal, lambda s: s != "")


def identifiers(found: Column, known: dict[str, str] = SENTENCES, gap: int = GAP) -> Column:
    """The sequence of the known sentences' identifiers as a string; ``|`` where more than ``gap`` unknown ones lie between."""
    table = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    hits = F.filter(F.transform(found, lambda s, k: F.struct(k.alias("at"), F.try_element_at(table, s).alias("id"))), lambda h: h["id"].isNotNull())
    return F.array_join(
        F.transform(hits, lambda h, k: F.concat(F.when((k > 0) & (h["at"] - F.get(hits, k - 1)["at"] > gap + 1), "|").otherwise(""), F.lit("<"), h["id"], F.lit(">"))), ""
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences and sentence_ids of texts with a marker, licences (sorted, joined by ;), n_matches and licence_class (none without)."""
    marked = F.translate(F.col("text"), _UPPER, _LOWER).rlike("|".join(MARKERS))
    found = docs.select("doc_id", F.when(marked, sentences(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("found"))
    ids = found.select("doc_id", F.size("found").cast("long").alias("n_sentences"), identifiers(F.col("found")).alias("sentence_ids"))
    ordered = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(p).alias("ids")) for name, p in patterns()])
    start = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<string>").alias("licences"))
    used = F.aggregate(
        ordered, start,
        lambda acc, r: F.when(F.contains(acc["left"], r["ids"]), F.struct(F.replace(acc["left"], r["ids"], F.lit("#")).alias("left"), F.array_append(acc["licences"], r["licence"]).alias("licences"))).otherwise(acc),
    )
    matched = ids.withColumn("used", F.when(F.col("sentence_ids") != "", used).otherwise(start))
    licences = F.array_sort(F.array_distinct("used.licences"))
    kind = F.lit("none")
    for name, members in reversed(CLASSES):
        kind = F.when(F.arrays_overlap(F.col("used.licences"), F.array(*map(F.lit, members))), name).otherwise(kind)
    n = F.length("used.left") - F.length(F.replace(F.col("used.left"), F.lit("#"), F.lit("")))
    return matched.select("doc_id", "n_sentences", "sentence_ids", F.array_join(licences, ";").alias("licences"), n.cast("long").alias("n_matches"), kind.alias("licence_class"))


def oracle_sql() -> str:
    """The same for DuckDB, over the view ``documents``."""
    text = "text"
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, '{pattern}', {_duck(to)}, 'g')"
    lower = f"'{_UPPER}', '{_LOWER}'"
    known = ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items())
    steps, found = "", []
    for k, (name, p) in enumerate(patterns()):
        steps += f",\n    replace(s{k}, '{p}', '#') AS s{k + 1}"
        found.append(f"CASE WHEN s{k + 1} <> s{k} THEN '{name}' END")
    classes = "".join(f" WHEN list_has_any(found, {list(m)}) THEN '{c}'" for c, m in CLASSES)
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN regexp_matches(translate(text, {lower}), '{"|".join(MARKERS)}') THEN
    list_filter(list_transform(string_split(translate({text}, {lower}), chr(10)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '')
    ELSE [] END AS found
  FROM documents
), known AS (
  SELECT doc_id, len(found) AS n_sentences,
    list_filter(list_transform(found, lambda s, k: {{'at': k, 'id': MAP {{{known}}}[s]}}), lambda h: h.id IS NOT NULL) AS hits
  FROM cut
), sequences AS (
  SELECT doc_id, n_sentences, coalesce(list_aggregate(list_transform(hits, lambda h, k:
    (CASE WHEN k > 1 AND h.at - hits[k - 1].at > {GAP + 1} THEN '|' ELSE '' END) || '<' || h.id || '>'), 'string_agg', ''), '') AS sentence_ids
  FROM known
), used AS (
  SELECT *, sentence_ids AS s0{steps}
  FROM sequences
), named AS (
  SELECT *, list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))) AS found FROM used
)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(found, ';') AS licences,
  length(s{len(found)}) - length(replace(s{len(found)}, '#', '')) AS n_matches, CASE{classes} ELSE 'none' END AS licence_class
FROM named
"""


def _duck(to: str) -> str:
    """A replacement as a DuckDB expression."""
    return "'" + to.replace("{", "\\").replace("}", "").replace("\n", "' || chr(10) || '") + "'"
