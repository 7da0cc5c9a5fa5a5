"""Licence scan by sentence rules: known sentences become identifiers, ordered identifier runs become licences.

Each text is normalised (lower case, runs of anything but letters and digits as one space) and marked where a sentence
can begin or end: after ``.``, ``!`` or ``?`` before white space, at a blank line, at a line end, and after ``:`` or ``;``
before white space. The first two part sentences; the others may also lie inside one, so a notice that is wrapped over
lines (also behind comment marks) is found. Of known sentences that begin at one place the longest counts. The identifiers of a document, in order, are matched against the rules; a rule is an ordered run of
identifiers with no other known sentence between them, and of the runs that begin at one identifier the longest counts, so
that three clauses aren't two. All of it is one projection of built-in functions over the
documents: no shuffle, no Python, and the work is proportional to the text.

Edge cases: a null or empty text has no sentences, and so an empty list of licences; a repeated sentence counts each
time; equal rows are scanned each for themselves; other columns are kept as they are, but for those that have the name of
a result column, which it replaces; an empty table gives no rows; a text of any length is one row's work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of public licence texts and notices, by identifier.
SENTENCES = {
    "afl-ref": "Licensed under the Academic Free License version 3.0",
    "agpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-1": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-2": "you may not use this file except in compliance with the License.",
    "apache-3": "You may obtain a copy of the License at",
    "apache-4": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "artistic-title": "The Artistic License 2.0",
    "bsd-0": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-ref": "Released under the BSD License.",
    "bsl-1": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc0-ref": "Released under CC0 1.0 Universal.",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl-title": "Eclipse Public License - v 2.0",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-ref": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-2": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "lgpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "mit-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-1": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-2": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-free": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit-ref": "Released under the MIT License.",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "reserved": "All rights reserved.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "warranty-1": 'The software is provided "as is", without warranty of any kind, express or implied.',
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software.",
}
# The licence that each ordered run of sentences stands for.
RULES = [
    ("0BSD", ["bsd-0"]),
    ("AFL-3.0", ["afl-ref"]),
    ("AGPL-3.0", ["agpl-1"]),
    ("AGPL-3.0", ["agpl-title"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-1"]),
    ("Apache-2.0", ["apache-2", "apache-3"]),
    ("Apache-2.0", ["apache-3", "apache-4"]),
    ("Apache-2.0", ["apache-title"]),
    ("Artistic-2.0", ["artistic-title"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-binary", "bsd-3"]),
    ("BSD-3-Clause", ["bsd-ref"]),
    ("BSD-4-Clause", ["bsd-1", "bsd-2", "bsd-binary", "bsd-4"]),
    ("BSL-1.0", ["bsl-1"]),
    ("BSL-1.0", ["bsl-title"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("EPL-2.0", ["epl-1"]),
    ("EPL-2.0", ["epl-title"]),
    ("GPL-2.0", ["gpl2-1"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("GPL-3.0", ["gpl-ref"]),
    ("GPL-3.0", ["gpl-1"]),
    ("GPL-3.0", ["gpl-title"]),
    ("ISC", ["isc-1"]),
    ("LGPL-2.1", ["lgpl21-1"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("LGPL-3.0", ["lgpl-1"]),
    ("LGPL-3.0", ["lgpl-title"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-0", "mit-1"]),
    ("MIT", ["mit-1", "mit-2"]),
    ("MIT", ["mit-1", "warranty-1"]),
    ("MIT-0", ["mit-free"]),
    ("MPL-2.0", ["mpl-ref"]),
    ("MPL-2.0", ["mpl-title"]),
    ("Proprietary", ["reserved"]),
    ("Unlicense", ["unlicense-1"]),
    ("Unlicense", ["unlicense-2"]),
    ("Zlib", ["zlib-1", "zlib-2"]),
]
# Licence identifiers that a line "SPDX-License-Identifier:" may name, each a sentence and a rule of its own.
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense Zlib".split()
SENTENCES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SPDX}
RULES += [(name.removesuffix("-only").removesuffix("-or-later"), [f"spdx-{name.lower()}"]) for name in SPDX]


def normalised(sentence: str) -> str:
    """As the operator normalises a sentence: ASCII lower case, anything but letters a to z and digits as one space."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(kept.split())


def _pieces() -> list[tuple[str, str]]:
    return [(normalised(s), key) for key, s in SENTENCES.items()]


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    body = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Capitals are free now: S parts sentences, L is a line end or clause end. Each pattern takes whole runs by classes of
    # characters: a repeated group would be matched by recursion, as deep as the run is long.
    for pattern, mark in ((r"[.!?][ \t\r\n]+", "S"), (r"\n[^a-z0-9S]*\n", "S"), (r"[:;][ \t\r]+|\n", "L"), ("[^a-z0-9SL]+", " "), ("[ L]*L[ L]*", "L"), ("[ L]?S[ SL]*", "S")):
        body = F.regexp_replace(body, pattern, mark)
    known = F.create_map(*[F.lit(x) for pair in _pieces() for x in pair])
    wanted = "|".join(a.replace(" ", "[ L]") for a, _ in sorted(_pieces(), key=lambda x: -len(x[0])))
    found = F.regexp_extract_all(F.concat(F.lit("S"), F.trim(body), F.lit("S")), F.lit(f"(?<=[SL])(?:{wanted})(?=[SL])"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.translate(s, "L", " ")))


def _runs(rules: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """Each rule's run of identifiers, every one between commas of its own, and its licence; longer runs first."""
    runs = [("".join(f",{x}," for x in ids), name) for name, ids in rules]
    return sorted(runs, key=lambda r: (-r[0].count(",,"), r))


def scan(df: DataFrame, text: str = "text", rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``df`` without its text, with sentence_ids and licences (sorted names, comma-joined) and n_sentences; columns of ``df``
    with these names are replaced."""
    runs = _runs(RULES if rules is None else rules)
    row = F.array_join(F.transform("_found", lambda x: F.concat(F.lit(","), x, F.lit(","))), "")
    name = F.create_map(*[F.lit(x) for pair in runs for x in pair])
    names = F.transform(F.regexp_extract_all(row, F.lit("|".join(re.escape(run) for run, _ in runs)), F.lit(0)), lambda x: F.try_element_at(name, x))
    kept = [f"`{c}`" for c in df.columns if c not in (text, "n_sentences", "sentence_ids", "licences", "_found")]
    return df.select(*kept, sentence_ids(F.col(f"`{text}`")).alias("_found")).select(
        *kept,
        F.size("_found").cast("long").alias("n_sentences"),
        F.array_join("_found", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licences"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`scan` over documents (doc_id) whose notices each stand on one line."""
    known = ", ".join(f"('{a}', '{key}')" for a, key in _pieces())
    cases = ", ".join(f"('{run}', '{name}')" for run, name in _runs(RULES))
    pattern = "|".join(run.replace(".", r"\.") for run, _ in _runs(RULES))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(run, name) AS (VALUES {cases}),
s AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?]|\n)[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)) AS sentences FROM documents),
e AS (SELECT doc_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS pos FROM s),
f AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, string_agg(',' || id || ',', '' ORDER BY pos) AS row FROM e JOIN known k ON k.sentence = trim(regexp_replace(e.sentence, '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
m AS (SELECT doc_id, unnest(regexp_extract_all(row, '{pattern}')) AS run FROM f),
r AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM m JOIN rules USING (run) GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n, 0) AS n_sentences, coalesce(f.ids, '') AS sentence_ids, coalesce(r.licences, '') AS licences
FROM documents d LEFT JOIN f USING (doc_id) LEFT JOIN r USING (doc_id)"""
