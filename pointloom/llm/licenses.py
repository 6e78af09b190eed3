"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each is normalised, and known licence sentences become identifiers; every run of other
sentences becomes one gap. The identifiers in order form a short string that is matched against the licence rules in
their order. A rule uses up what it matches, so a full licence text is not also reported by a rule for a part of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and sentence, as in the public licence texts and notices.
SENTENCES = {
    "mit_title": "MIT License",
    "mit_the_title": "The MIT License (MIT)",
    "mit_short": "Released under the MIT License",
    "mit_under": "Licensed under the MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache_short": "Licensed under the Apache License, Version 2.0",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_comply": "you may not use this file except in compliance with the License",
    "apache_obtain": "You may obtain a copy of the License at",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl2_work": "This work is licensed under the GNU General Public License, version 2",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc0_dedicate": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense_domain": "This is free and unencumbered software released into the public domain",
    "cc_by_short": "Licensed under CC BY 4.0",
    "cc_by_sa_short": "Licensed under CC BY-SA 4.0",
    "cc_by_nc_short": "Licensed under CC BY-NC 4.0",
    "cc_by_work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_sa_work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc_by_nc_work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "all_rights": "All rights reserved",
}
#: The grants of the GNU licences, as (identifier, licence, its title, version), in every form of the version.
GRANTS = (
    ("agpl", "AGPL-3.0", "GNU Affero General Public License", "3"),
    ("lgpl", "LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("lgpl21", "LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("gpl3", "GPL-3.0", "GNU General Public License", "3"),
    ("gpl2", "GPL-2.0", "GNU General Public License", "2"),
)
FORMS = {"or-later": "either version {} of the License, or (at your option) any later version", "only": "version {} of the License"}
SENTENCES |= {
    f"{name}_{form.replace('-', '_')}_{mark}": f"you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation{sign} {FORMS[form].format(version)}"
    for name, _, title, version in GRANTS
    for form in FORMS
    for mark, sign in (("comma", ","), ("semicolon", ";"))
}
#: Identifiers of licences, and the names by which short notices call them.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License 2.0",),
    "GPL-2.0-only": ("GNU General Public License v2.0",),
    "GPL-3.0-only": ("GNU General Public License v3.0",),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0",),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0",),
    "Unlicense": ("Unlicense",),
}
#: What short notices say of such a name.
NOTICES = ("This project is licensed under the {}", "This software is licensed under the {}", "This library is licensed under the {}", "This code is licensed under the {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "{}, see the file", "{}, see the LICENSE file", "See the LICENSE file for the {}")
_LONGER = set(SENTENCES.values())
SHORT = {of: {f"short_{of}_{n}_{k}": form.format(name) for n, name in enumerate(names) for k, form in enumerate(NOTICES) if form.format(name) not in _LONGER} | {f"spdx_{of}": f"SPDX-License-Identifier {of}"} for of, names in NAMES.items()}
SENTENCES |= {k: v for own in SHORT.values() for k, v in own.items()}
#: Licence and the sentence identifiers that stand for it, in the order in which rules are tried. "?" ends an
#: optional identifier, "|" parts those of which one is asked for; between identifiers one gap may lie.
RULES = (
    ("MIT", ("mit_title?", "mit_the_title?", "mit_grant", "mit_notice", "mit_warranty?")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_header", "apache_comply?", "apache_obtain?", "apache_basis?")),
    *((f"{of}-{form}", ("|".join(f"{name}_{form.replace('-', '_')}_{mark}" for mark in ("comma", "semicolon")), "gpl_warranty?")) for name, of, _, _ in GRANTS for form in FORMS),
    ("ISC", ("isc_grant",)),
    ("MPL-2.0", ("mpl_notice",)),
    ("CC0-1.0", ("cc0_dedicate",)),
    ("Unlicense", ("unlicense_domain",)),
    ("Apache-2.0", ("apache_short",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_under",)),
    ("GPL-3.0-only", ("gpl3_work",)),
    ("GPL-2.0-only", ("gpl2_work",)),
    ("CC-BY-4.0", ("cc_by_short",)),
    ("CC-BY-4.0", ("cc_by_work",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_short",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_work",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_work",)),
    *((of, ("|".join(own),)) for of, own in SHORT.items()),
    ("proprietary", ("all_rights",)),
)
#: Where sentences end: at a full stop or the like before white space, and at a blank line. Every known sentence is cut alike.
ENDS = r"[.!?;:]+\s+|\n\s*\n"
NOISE = r"[^a-z0-9]+"
#: Every known sentence holds one of these in one of its pieces, none of which a line can break; a text without any has no known sentence.
HINTS = ("licen", "copyright", "warrant", "permission", "redistribut", "domain", "reserved", "obtain")
GAP = "_"
#: A tag of which the colon ends no sentence; it goes before sentences are cut.
TAG = r"(spdx-license-identifier):[ \t]*"


def normalise(sentence: str) -> str:
    """What normalised() does, for one sentence."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).strip()


def pieces(sentence: str) -> list[str]:
    """The normalised pieces into which the cutting itself divides a known sentence."""
    return [" ".join(x.split()) for x in map(normalise, re.split(ENDS, sentence)) if x]


def known() -> dict[str, str]:
    """Normalised sentence -> identifier. The pieces of a sentence that the cutting divides stand numbered, each once."""
    out = {}
    for name, s in SENTENCES.items():
        parts = pieces(s)
        if not any(any(h in p for h in HINTS) for p in parts):
            raise ValueError("a known sentence holds none of the hints")
        for k, p in enumerate(parts, 1):
            out.setdefault(p, name if len(parts) == 1 else f"{name}_{k}")
    return out


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(sentence, NOISE, " "))


def rule_pattern(ids: tuple[str, ...]) -> str:
    """A rule over a string like ,a,b,_,c, — each identifier stands between commas, the pieces of a sentence side by side."""
    out, first, table = ",", True, known()
    for x in ids:
        names = [",".join(table[p] for p in pieces(SENTENCES[y])) for y in x.rstrip("?").split("|")]
        name = names[0] if len(names) == 1 else f"(?:{'|'.join(names)})"
        gap = "" if first else f"(?:{GAP},)?"
        out += f"(?:{gap}{name},)?" if x.endswith("?") else f"{gap}{name},"
        first = first and x.endswith("?")
    return out


def lines_pattern() -> str:
    """A known sentence that fills whole lines, or runs from the end of another sentence to the end of a line or back.

    Noise is taken possessively and up to the line's end only, so the time stays in proportion to the text.
    """
    before = r"(?:(?:\A|\n)[^a-z0-9\n]*+|(?<=[.!?;:])\s[^a-z0-9\n.!?;:]*+)"
    after = r"[^a-z0-9\n]*?(?=\n|\z|(?<=[.!?;:])\s)"
    return before + "(?:" + "|".join("[^a-z0-9]++".join(x.split()) for x in sorted(known(), key=len, reverse=True)) + ")" + after


def identifiers(text: Column, lines: bool = True) -> Column:
    """The known sentences of a text in order, as ,id,id,_,id, with _ for each run of others; null where there is none."""
    low = F.regexp_replace(F.lower(text), TAG, "$1 ")
    table = F.create_map(*[F.lit(x) for pair in known().items() for x in pair])
    ids = F.transform(F.split(F.regexp_replace(low, lines_pattern(), "\n\n$0\n\n") if lines else low, ENDS), lambda s: F.coalesce(F.try_element_at(table, normalised(s)), F.lit(GAP)))
    runs = F.regexp_replace(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")), f"(?<=,)(?:{GAP},)+", f"{GAP},")
    hit = low.rlike("|".join(HINTS))
    return F.when(hit, F.when(runs == f",{GAP},", F.lit(None)).otherwise(runs))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: bool = True) -> DataFrame:
    """Per row of docs: doc_id, sentences (identifiers in order), licenses (names in rule order, each once).

    A line feed may end a sentence: known sentences are also found on lines of their own, wrapped or not; without lines only
    at the ENDS. The whole text is read. A null or empty text has no sentences; a null id is kept. Repeated rows give equal rows, an
    empty table none. There is no shuffle. Other columns are not looked at.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.col(text_col), lines).alias("found")).withColumn("rest", F.col("found"))
    flags = []
    for k, (name, ids) in enumerate(RULES):
        pat = rule_pattern(ids)
        out = out.withColumn(f"r{k}", F.coalesce(F.col("rest").rlike(pat), F.lit(False)))
        out = out.withColumn("rest", F.when(F.col(f"r{k}"), F.regexp_replace("rest", pat, f",{GAP},")).otherwise(F.col("rest")))
        flags.append(F.when(F.col(f"r{k}"), F.lit(name)))
    names = F.array_distinct(F.array_compact(F.array(*flags)))
    ids = F.filter(F.split(F.coalesce("found", F.lit("")), ","), lambda s: (s != "") & (s != GAP))
    return out.select("doc_id", ids.alias("sentences"), names.alias("licenses"))
