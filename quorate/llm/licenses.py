"""Licence scans: known sentences to identifiers, identifier sequences to rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    2: "you may not use this file except in compliance with the License.",
    3: "You may obtain a copy of the License at",
    4: "http://www.apache.org/licenses/LICENSE-2.0",
    5: "Licensed under the Apache License, Version 2.0.",
    6: "Released under the MIT License.",
    7: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    8: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    9: "This work is licensed under the GNU General Public License, version 3.",
    10: "This program is free software",
    11: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    12: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    13: "Licensed under CC BY-NC 4.0.",
    14: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    15: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    17: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    18: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    20: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    21: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    24: "This is free and unencumbered software released into the public domain.",
    25: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    26: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    27: "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    28: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    29: "See the License for the specific language governing permissions and limitations under the License.",
    30: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    31: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    32: "See the GNU General Public License for more details.",
    33: "You should have received a copy of the GNU General Public License along with this program.",
    34: "This library is free software",
    35: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    36: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    37: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    38: "Distributed under the Boost Software License, Version 1.0.",
    41: "Apache License Version 2.0, January 2004",
    42: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    43: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    44: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    45: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    46: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    47: "Mozilla Public License Version 2.0",
    48: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    49: "Licensed under the MIT License.",
    50: "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    51: "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    52: "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    53: "Licensed under the BSD 3-Clause License.",
    54: "Licensed under the GNU General Public License v3.0.",
    55: "Licensed under the Apache License 2.0.",
    56: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    57: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer in this position and unchanged.",
    58: "Boost Software License - Version 1.0 - August 17th, 2003",
    59: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    60: "Licensed under the Creative Commons CC0 1.0 Universal license.",
}

# Which sentences, in this order, make which licence; a longer rule replaces those it begins.
RULES = [
    ("Apache-2.0", (1, 2)),
    ("Apache-2.0", (1, 3, 4)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (41,)),
    ("Apache-2.0", (55,)),
    ("MIT", (6,)),
    ("MIT", (7, 8)),
    ("MIT", (49,)),
    ("GPL-3.0-only", (9,)),
    ("GPL-3.0-only", (42,)),
    ("GPL-3.0-only", (54,)),
    ("GPL-2.0-only", (43,)),
    ("GPL-3.0-or-later", (10, 11)),
    ("GPL-2.0-or-later", (10, 12)),
    ("CC-BY-NC-4.0", (13,)),
    ("CC-BY-4.0", (14,)),
    ("CC-BY-SA-4.0", (15,)),
    ("CC0-1.0", (60,)),
    ("BSD-3-Clause", (16, 17, 18, 19)),
    ("BSD-3-Clause", (16, 17, 18, 50)),
    ("BSD-3-Clause", (53,)),
    ("BSD-2-Clause", (16, 17, 18)),
    ("ISC", (20,)),
    ("ISC", (48,)),
    ("MPL-2.0", (21,)),
    ("MPL-2.0", (47,)),
    ("Unlicense", (24,)),
    ("LGPL-2.1-only", (44,)),
    ("LGPL-2.1-or-later", (34, 35)),
    ("LGPL-3.0-only", (45,)),
    ("LGPL-3.0-or-later", (34, 56)),
    ("AGPL-3.0-only", (46,)),
    ("AGPL-3.0-or-later", (10, 36)),
    ("Zlib", (37,)),
    ("BSL-1.0", (38,)),
    ("BSL-1.0", (58,)),
]

# Where a sentence names someone or something, with the words that stand for it.
GAPS = [
    (r"^neither the names? of .{1,200}? nor the names? of (its|any|their) contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
    (r"^the names? of .{1,200}? may not be used to endorse", "the name of the author may not be used to endorse"),
    (r"^this software is provided by .{1,200}? as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (r"^(this|the|these|all) [a-z0-9 ]{1,60}? (is|are) (licensed|distributed) under ", "licensed under "),
]
# A clause that no two-clause licence has.
ENDORSE = "endorse or promote products derived from this software"
#: A text without any of these in a word holds no known sentence.
ANCHORS = "licen|permi|redistribut|software|conditions|copyright|warrant"
#: Into how many parts, lines mostly, a known sentence may be broken.
MOST_PARTS = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(sentence: str) -> str:
    """Letters and digits of ASCII in lower case, one space for everything else; gaps as ``GAPS`` has them."""
    words = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower().split())
    for pattern, filled in GAPS:
        words = re.sub(pattern, filled, words)
    return words


KNOWN = {_plain(s): i for i, s in SENTENCES.items()}
# Where a sentence may begin or end. A known sentence may hold any of these inside. Line ends, with the
# mark of a comment or of a list after them:
_LINES = r"(^|[\r\n]+)[ \t]*((dnl|rem)[ \t]+)?(\(?[0-9a-z][0-9a-z]?[.)][ \t]+)?"
# sentence signs before white space,
_SIGNS = r"""[.!?;:]["')\]]*([ \t\n\x0B\f\r|]|\z)"""
# and tags of HTML.
_TAGS = r"<[a-z/!][^<>]{0,200}>"
# A licence expression after its mark, and what in it is no licence.
_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
_EXCEPTION = r"(?i)(^|[() \t])WITH[ \t]+[A-Za-z0-9.-]+"


def _first_words(sentence: str) -> str:
    return " ".join(sentence.split(" ")[:2])


def sentence_parts(text: Column) -> Column:
    """The text as plain words, in parts: what stands between two places where a sentence may begin or end."""
    lower = F.translate(text, _UPPER + "|", _LOWER + " ")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, _TAGS, "\n"), _LINES, "|"), _SIGNS, "|")
    parts = F.split(F.regexp_replace(cut, "[^a-z0-9|]+", " "), r" *[|][ |]*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def _known_at(parts: Column, known: Column) -> Column:
    """Numbers of the known sentences, in order: at each part that may begin one, the longest run of
    parts that is one."""
    firsts = sorted({w for s in KNOWN for w in (_first_words(s), s.split(" ")[0])})
    heads = r"^(neither the|the names?|this|the|these|all)( |$)"
    starts = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.substring_index(F.get(parts, i), " ", 2).isin(firsts) | F.get(parts, i).rlike(heads))

    def words(i: Column, n: Column) -> Column:
        joined = F.array_join(F.slice(parts, i + 1, n), " ")
        for pattern, filled in GAPS:
            joined = F.regexp_replace(joined, pattern, filled)
        return joined

    def number(i: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(MOST_PARTS), F.lit(1), F.lit(-1)), lambda n: F.try_element_at(known, words(i, n)))
        return F.try_element_at(F.filter(runs, lambda x: x.isNotNull()), F.lit(1))

    return F.when(F.size(parts) > 0, F.filter(F.transform(starts, number), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """The known licence sentences of each whole text, in order, and the licences they make.

    Texts are compared as ASCII letters and digits in lower case. A text is cut once into parts: at line
    ends, sentence signs (colons too) before white space, and tags. A run of up to ``MOST_PARTS`` parts
    is looked up among the known sentences, longest first, so one may be wrapped over lines, with
    comment marks; names of holders are gaps (``GAPS``). The sentences' numbers are matched against the
    rules: the numbers of a rule must follow each other, with any unknown text between. A BSD text with
    the clause of names is BSD-3-Clause, whatever way it has it. Licences of SPDX expressions are
    taken as they are written, without exceptions (WITH). All within a row, without a shuffle; the known
    sentences are a literal of the plan, and a text that has none of their words is not cut.

    Null and empty texts have no licence. Rows that repeat are scanned each. Columns besides doc_id
    and text are ignored. Returns doc_id, n_sentences, sentence_ids (joined by spaces, in order), spdx
    (expressions in order, joined by semicolons) and licences (joined by commas, in the order of names),
    empty strings where there is none."""
    known = F.create_map(*(F.lit(x) for pair in sorted(KNOWN.items()) for x in pair))
    text = F.coalesce(F.col("text"), F.lit(""))
    may = F.col("text").rlike(f"(?i){ANCHORS}")
    nothing = F.array().cast("array<string>")
    cut = docs.select("doc_id", F.when(may, sentence_parts(text)).otherwise(nothing).alias("parts"), F.when(may, F.transform(F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t.")))).otherwise(nothing).alias("spdx"))
    found = cut.select("doc_id", "spdx", _known_at(F.col("parts"), known).alias("ids"), F.array_join("parts", " ").contains(ENDORSE).alias("endorse"))
    joined = F.concat(F.lit(" "), F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), F.lit(" "))
    holds = {rule: joined.contains(" " + " ".join(map(str, rule)) + " ") for _, rule in RULES}
    names = []
    for name, rule in RULES:
        longer = [holds[more] for _, more in RULES if len(more) > len(rule) and more[: len(rule)] == rule]
        alone = reduce(lambda c, h: c & ~h, longer, holds[rule])
        names.append(F.when(alone, F.when(F.col("endorse"), "BSD-3-Clause").otherwise(name) if name == "BSD-2-Clause" else F.lit(name)))
    tokens = F.split(F.regexp_replace(F.array_join("spdx", " "), _EXCEPTION, " "), r"[() \t]+")
    operands = F.filter(tokens, lambda x: ~F.lower(x).isin("", "or", "and", "with"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.trim(joined).alias("sentence_ids"),
        F.array_join("spdx", ";").alias("spdx"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*names)), operands))), ",").alias("licences"),
    )


def _filled(column: str) -> str:
    for pattern, filled in GAPS:
        column = f"regexp_replace({column}, '{pattern}', '{filled}')"
    return column


#: DuckDB SQL for ``op8_license_scan``. It goes the other way about: lines first, then the marks at their
#: heads, then signs; each part joined with those after it; rules held against lists of numbers.
LICENSE_SQL = rf"""
WITH known(s, i) AS (VALUES {", ".join(f"('{s}', {i})" for s, i in KNOWN.items())}),
rules(name, run) AS (VALUES {", ".join(f"('{name}', ' {' '.join(map(str, rule))} ')" for name, rule in RULES)}),
longer AS (SELECT a.name, a.run, list(b.run) FILTER (b.run IS NOT NULL) AS more FROM rules a LEFT JOIN rules b ON starts_with(b.run, a.run) AND b.run <> a.run GROUP BY ALL),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ|', 'abcdefghijklmnopqrstuvwxyz '), '<[a-z/!][^<>]{{0,200}}>', chr(10), 'g'), '[\r\n]+') AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS n FROM texts),
bare AS (SELECT r, n, string_split_regex(regexp_replace(line, '^[ \t]*((dnl|rem)[ \t]+)?(\(?[0-9a-z][0-9a-z]?[.)][ \t]+)?', ''), '[.!?;:]["'')\]]*([ \t\x0B\f]|\z)') AS cut FROM lines),
cut AS (SELECT r, n, unnest(cut) AS part, generate_subscripts(cut, 1) AS m FROM bare),
parts AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY n, m) AS place, part FROM (SELECT r, n, m, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS part FROM cut) WHERE part <> ''),
ahead AS (SELECT r, place, list(part) OVER (PARTITION BY r ORDER BY place ROWS BETWEEN CURRENT ROW AND {MOST_PARTS - 1} FOLLOWING) AS next FROM parts),
-- A run begins as a known sentence or a gap does.
likely AS (SELECT * FROM ahead WHERE string_split(next[1], ' ')[1] IN (SELECT string_split(s, ' ')[1] FROM known UNION ALL SELECT unnest(['neither', 'the', 'this', 'these', 'all']))),
runs AS (SELECT r, place, n, {_filled("array_to_string(next[1:n], ' ')")} AS s FROM likely, range(1, {MOST_PARTS + 1}) AS lengths(n) WHERE n <= len(next)),
hits AS (SELECT r, place, arg_max(i, n) AS i FROM runs JOIN known USING (s) GROUP BY r, place),
numbered AS (SELECT r, count(*) AS n, string_agg(i::VARCHAR, ' ' ORDER BY place) AS ids FROM hits GROUP BY r),
endorsed AS (SELECT r, contains(string_agg(part, ' ' ORDER BY place), '{ENDORSE}') AS e FROM parts GROUP BY r),
named AS (SELECT n.r, CASE WHEN l.name = 'BSD-2-Clause' AND e THEN 'BSD-3-Clause' ELSE l.name END AS name FROM numbered n JOIN endorsed USING (r) JOIN longer l ON contains(' ' || ids || ' ', l.run)
  AND len(list_filter(coalesce(l.more, []), lambda m: contains(' ' || ids || ' ', m))) = 0),
spdx AS (SELECT r, list_transform(regexp_extract_all(text, '(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)', 1), lambda x: trim(x, chr(32) || chr(9) || '.')) AS e FROM texts),
operands AS (SELECT r, unnest(string_split_regex(regexp_replace(array_to_string(e, ' '), '(?i)(^|[() \t])WITH[ \t]+[A-Za-z0-9.-]+', ' ', 'g'), '[() \t]+')) AS name FROM spdx),
every AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM (SELECT * FROM named UNION ALL SELECT * FROM operands WHERE lower(name) NOT IN ('', 'or', 'and', 'with')) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, array_to_string(e, ';') AS spdx, coalesce(licences, '') AS licences
FROM texts JOIN spdx USING (r) LEFT JOIN numbered USING (r) LEFT JOIN every USING (r)
"""
