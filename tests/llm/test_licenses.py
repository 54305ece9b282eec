import re
import textwrap

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tallywright.llm import licenses

from tests.compare import differences

SCHEMA = "doc_id long, text string, licenses string, sentences_ int"

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

The software is provided "as is", without warranty of any kind, express or
implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. In no event shall the
authors or copyright holders be liable for any claim, damages or other
liability, whether in an action of contract, tort or otherwise, arising from,
out of or in connection with the software or the use or other dealings in the
software.
"""


def brute(text):
    for pattern, put in licenses.BREAKS:
        text = re.sub(pattern, put.replace("$1", r"\1"), text)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [s for s in (re.sub("[^a-z0-9]+", " ", part.translate(low)).strip(" ") for part in text.split("\x01")) if s]
    by_sentence = {v: k for k, v in licenses.SENTENCES.items()}
    seq = [by_sentence[s] for s in own if s in by_sentence]
    rest, found = list(seq), []
    for name, ids in licenses.RULES:
        i = 0
        hit = False
        while i + len(ids) <= len(rest):
            if tuple(rest[i:i + len(ids)]) == ids:
                del rest[i:i + len(ids)]
                hit = True
            else:
                i += 1
        if hit and name not in found:
            found.append(name)
    found = [f for f in found if f != "Proprietary" or len(found) == 1]
    return len(own), seq, found


def test_known_licences_are_recognised_in_order(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3"
    texts = [
        MIT, "words before.\nReleased under the MIT License.\nWords after", "Licensed under the Apache License, Version 2.0.", MIT + "\nLicensed under CC BY-NC 4.0.\n" + MIT,
        "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        None, "", ". . .", "Überall: no licence, nirgends.", gpl, "word " * 100_000,
    ]
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        n, seq, found = brute(t or "")
        assert (got[i]["n_sentences"], got[i]["identifiers"], got[i]["licenses"]) == (n, seq, found)
    assert got[None]["licenses"] == ["MIT"] and got[3]["licenses"] == ["MIT", "CC-BY-NC-4.0"] and got[4]["licenses"] == ["GPL-3.0-only"]
    assert got[5]["licenses"] == [] and got[5]["unexplained"] == ["MitNotice"]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tables_are_consistent():
    assert all(i in licenses.SENTENCES for _, ids in licenses.RULES for i in ids)
    assert all(re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) for s in licenses.SENTENCES.values())


def wrapped(text, mark, width):
    return "\n".join((mark + line).rstrip() for part in text.split("\n\n") for line in [*textwrap.wrap(" ".join(part.split()), width), ""])


GPL = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details.

You should have received a copy of the GNU {2} along with this program. If not, see <https://www.gnu.org/licenses/>."""
AS_IS = "THE SOFTWARE IS PROVIDED"
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
VERBATIM = {
    "MIT": MIT.split("The software is provided")[0] + AS_IS + """ "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": BSD,
    "BSD-2-Clause": BSD.split("3. ")[0] + "THIS" + BSD.split("\n\nTHIS")[1],
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + AS_IS + ' "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.',
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": GPL.format("program", ":", "General Public License", ",", "3"),
    "GPL-2.0-or-later": GPL.format("program", ";", "General Public License", ";", "2"),
    "LGPL-2.1-or-later": GPL.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "AGPL-3.0-or-later": GPL.format("program", ":", "Affero General Public License", ",", "3"),
    "LGPL-3.0-or-later": GPL.format("library", ":", "Lesser General Public License", ",", "3"),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def test_verbatim_texts_and_comment_headers(spark):
    cases = [(name, mark, width) for name in VERBATIM for mark in ("", " * ", "// ", "# ", "-- ") for width in (60, 71, 78, 10_000)]
    rows = [(i, "x = 1\n\n" + wrapped(VERBATIM[name], mark, width) + "\ny = 2", "x", 1) for i, (name, mark, width) in enumerate(cases)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(c, got[i]["licenses"]) for i, c in enumerate(cases) if got[i]["licenses"] != [c[0]]] == []
    full = {"MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "MPL-2.0"}
    assert [c for i, c in enumerate(cases) if c[0] in full and got[i]["unexplained"]] == []


def test_pieces_that_only_touch_a_sentence_are_not_it(spark):
    rows = [(0, "Not released under the MIT License.", "x", 1), (1, "Released under the MIT License terms.", "x", 1), (2, "Released: under the\nMIT License", "x", 1)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: [], 1: [], 2: ["MIT"]}


OTHERS = {
    "All rights reserved.": ["Proprietary"],
    "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + BSD: ["BSD-3-Clause"],
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}": ["GPL-2.0-or-later"],
    "/* SPDX-License-Identifier: MIT */\n#include <x>": ["MIT"],
    "x = 1\n# SPDX-License-Identifier: LGPL-3.0-only\n# All rights reserved.\n": ["LGPL-3.0-only"],
    "SPDX-License-Identifier: MIT OR Apache-2.0\n": [],
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.": ["GPL-3.0"],
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989": ["GPL-2.0"],
    "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n": ["LGPL-3.0"],
    "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n": ["AGPL-3.0"],
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS": ["Apache-2.0"],
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions": ["MPL-2.0"],
    "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM": ["EPL-2.0"],
    "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted": ["BSL-1.0"],
}


def test_titles_identifier_lines_and_reserved_rights(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(OTHERS)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(rows))] == list(OTHERS.values())


def test_the_twin_agrees_on_licence_texts(spark, tmp_path):
    texts = [wrapped(v, mark, width) for v in VERBATIM.values() for mark in ("", " * ", "# ") for width in (60, 10_000)] + [*OTHERS, "", None, MIT + MIT, MIT + BSD + "\nAll rights reserved. All rights reserved."]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert differences(licenses.op1_licenses(spark, str(tmp_path)), con, licenses.ORACLE_SQL) == ""
