import textwrap

import pytest

from quorate.llm.licenses import SENTENCES as S
from quorate.llm.licenses import LICENSE_SQL, scan_licenses

MIT = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{S[7]}:\n\n{S[8]}\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"."
BSD = f"Copyright 2020, A. Person\n\n{S[16]}:\n\n1. {S[17]}\n\n2. {S[18]}\n\n3. {S[19]}\n\nTHIS SOFTWARE IS PROVIDED."
GPL3 = f"{S[10]}: {S[11]}\n\nThis program is distributed in the hope that it will be useful."
#: As published, wrapped by hand.
PUBLISHED_MIT = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
PUBLISHED_GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
PUBLISHED_APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL2 = f"{S[10]}; {S[12]}"
MPL = f"{S[21]} If a copy of the MPL was not distributed with this file, You can obtain one at x."
APACHE = f"{S[1]};\n{S[2]}\n{S[3]}\n\n    {S[4]}\n\nUnless required by applicable law"


def wrapped(text, width=72, mark=""):
    lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width) or [""])]
    return "\n".join(f"{mark}{line}".rstrip() for line in lines)


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// ", "dnl "])
def test_wrapped_texts(spark, mark):
    want = {1: "MIT", 2: "BSD-3-Clause", 3: "GPL-3.0-or-later", 4: "GPL-2.0-or-later", 5: "ISC", 6: "MPL-2.0", 7: "Apache-2.0", 8: "MIT"}
    texts = [MIT, BSD, GPL3, GPL2, S[20], MPL, APACHE]
    rows = [(i, wrapped(t, mark=mark)) for i, t in enumerate(texts, 1)] + [(8, wrapped(MIT, mark=mark).replace("\n", "\r\n"))]
    got = {r.doc_id: r.licences for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_notices_at_lines_colons_and_within_sentences(spark):
    rows = [
        (1, GPL3), (2, "// SPDX-License-Identifier: MIT\nimport os"), (3, "Licence: Released under the MIT License."),
        (4, "It is not released under the MIT License."), (5, "| Released under the MIT License |"), (6, S[21].replace("2.0", "3.0")),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("10 11", "GPL-3.0-or-later"), 2: ("", "MIT"), 3: ("6", "MIT"), 4: ("", ""), 5: ("6", "MIT"), 6: ("", "")}


def hard_rows():
    texts = [MIT, BSD, GPL3, GPL2, S[20], MPL, APACHE, PUBLISHED_MIT, PUBLISHED_GPL, PUBLISHED_APACHE]
    texts += [wrapped(x, mark=m) for x in texts for m in (" * ", "# ", "dnl ")]
    texts += [None, "", "a. . b) (2) c", "|||", "..\n\n1. \u2028", ". " + S[6], S[6] + S[6], f"{S[6]}\x0b{S[13]}\u2028", f"(a) {S[24]} b. {S[38]}", f"{S[35]} {S[34]}: {S[35]}", "x. " * 20_000 + S[37]]
    texts += [t for t, _ in WILD.values()]
    return [(i % 40, t) for i, t in enumerate(texts)]


def test_published_texts(spark):
    rows = [(1, PUBLISHED_MIT), (2, PUBLISHED_GPL), (3, PUBLISHED_APACHE)]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("7 8 25 26", "MIT"), 2: ("10 11 30 31 32 33", "GPL-3.0-or-later"), 3: ("1 2 3 4 28 29", "Apache-2.0")}


def test_equals_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = hard_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(f"SELECT doc_id, n_sentences, sentence_ids, spdx, licences FROM ({LICENSE_SQL})").fetchall()
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


BSD_UNIVERSITY = BSD.replace("the copyright holder nor", "the University of Somewhere, Inc. nor")
WILD = {
    "university": (wrapped(BSD_UNIVERSITY, mark=" * "), "BSD-3-Clause"),
    "author": (wrapped(BSD.replace(S[19], S[50].replace("the author", "A. Person"))), "BSD-3-Clause"),
    "reworded": (wrapped(BSD.replace(S[19], "You shall not use our names to endorse or promote products derived from this software.")), "BSD-3-Clause"),
    "two": (wrapped(BSD.replace(S[19], "")), "BSD-2-Clause"),
    "spdx later": ("// SPDX-License-Identifier: GPL-3.0-or-later\nint x;", "GPL-3.0-or-later"),
    "spdx lesser": ("/* SPDX-License-Identifier: LGPL-2.1-only */", "LGPL-2.1-only"),
    "spdx or": ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT"),
    "spdx with": ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0-only"),
    "isc": (wrapped(S[48], 60, "; "), "ISC"),
    "apache text": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
    "gpl text": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", "GPL-3.0-only"),
    "this file": ("This file is licensed under the MIT license.", "MIT"),
    "br": (wrapped(MIT).replace("\n", "<br>\n<br />"), "MIT"),
    "none": ("It is licensed under terms that nobody knows. SPDX-License-Identifier", ""),
}


def test_texts_as_they_are_found(spark):
    rows = [(i, text) for i, (text, _) in enumerate(WILD.values())]
    got = {r.doc_id: r.licences for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {name: got[i] for i, name in enumerate(WILD)} == {name: want for name, (_, want) in WILD.items()}


def test_every_known_sentence_has_an_anchor():
    import re

    from quorate.llm.licenses import ANCHORS, KNOWN

    assert [s for s in KNOWN if not re.search(ANCHORS, s)] == []
