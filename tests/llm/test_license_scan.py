import duckdb

from weftarc.llm import license_scan as L

MIT = """// The MIT License (MIT)
//
// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
// associated documentation files (the "Software"), to deal in the Software without restriction, including
// without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
// copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
// following conditions:
//
// The above copyright notice and this permission notice shall be included in all copies or substantial
// portions of the Software.
//
// THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
// LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
TEXTS = [
    None, "", "plain text. no such thing", "Some prose.\nReleased under the MIT License.\nMore prose", "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0.\n\nAll rights reserved.\n", "this work is licensed under the gnu general public license, VERSION 3!",
    "It was released under the MIT license of sorts.", MIT, "This is free software; you can redistribute it and/or modify it.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nA.\nB.\n"
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "All rights reserved. a. b. c. d. All rights reserved.",
]


def test_every_known_sentence_is_normal_and_has_a_marker():
    for s in L.SENTENCES.values():
        assert any(m in s for m in L.MARKERS), s
    assert len(set(L.SENTENCES.values())) == len(L.SENTENCES)
    assert {i for _, ids in L.RULES for i in ids} <= set(L.SENTENCES)
    assert {n for n, _ in L.RULES} == {n for _, names in L.CLASSES for n in names}


def scanned(spark, texts):
    return {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_licences(spark):
    got = {i: (r.licences, r.licence_class) for i, r in scanned(spark, TEXTS).items()}
    assert got == {
        0: ("", "none"), 1: ("", "none"), 2: ("", "none"), 3: ("MIT", "permissive"), 4: ("CC-BY-NC-4.0", "restricted"),
        5: ("All-Rights-Reserved;Apache-2.0", "restricted"), 6: ("GPL-3.0", "copyleft"), 7: ("", "none"), 8: ("MIT", "permissive"), 9: ("", "none"),
        10: ("BSD-2-Clause", "permissive"), 11: ("All-Rights-Reserved", "restricted"),
    }


def test_a_full_text_is_one_match_and_gaps_break_sequences(spark):
    got = scanned(spark, TEXTS)
    assert got[8].sentence_ids == "<mit.title><mit.grant><mit.notice><mit.as-is>" and got[8].n_matches == 2
    assert got[10].sentence_ids == "<bsd.grant><bsd.source><bsd.binary>" and got[10].n_matches == 1
    assert got[11].sentence_ids == "<arr.reserved>|<arr.reserved>"


def test_against_duckdb(spark):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(TEXTS)))
    want = {r[0]: r for r in con.execute(L.oracle_sql()).fetchall()}
    assert {i: tuple(r) for i, r in scanned(spark, TEXTS).items()} == want


def test_plan_has_no_python_and_no_shuffle(spark):
    df = L.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

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
""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "GPL-3.0": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
""",
    "GPL-2.0": """# This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
# License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
# version.
""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.\n",
}


def test_published_notices_are_one_match_of_their_licence(spark):
    got = scanned(spark, list(PUBLISHED.values()))
    assert {name: got[i].licences for i, name in enumerate(PUBLISHED)} == {name: name for name in PUBLISHED}
    found = {name: got[i].sentence_ids for i, name in enumerate(PUBLISHED)}
    assert found["Apache-2.0"] == "<apache.the-license><apache.compliance><apache.copy-at><apache.url><apache.as-is><apache.see>"
    assert found["GPL-3.0"] == "<gpl.free><gpl.hope><gpl.details>"
    assert found["MPL-2.0"] == "<mpl2.notice><mpl2.obtain>"
    assert found["BSD-3-Clause"] == "<bsd.grant><bsd.source><bsd.binary><bsd.endorse><bsd.as-is>"
    assert found["MIT"] == "<mit.short-title><mit.grant><mit.notice><mit.as-is><mit.liability>"


def test_every_spdx_line(spark):
    lines = [(name, i) for name, ids in L.SPDX.items() for i in ids]
    got = scanned(spark, [f"/* code */\n// SPDX-License-Identifier: {i}\nint main;" for _, i in lines])
    assert {lines[k]: r.licences for k, r in got.items()} == {(name, i): name for name, i in lines}


def test_empty_table_clashing_columns_and_a_very_long_text(spark):
    schema = "doc_id long, text string, found string, sentence_ids string, used string"
    assert L.scan(spark.createDataFrame([], schema)).count() == 0
    long = "Words of a sentence. " * 200_000 + "\nReleased under the MIT License.\n"
    rows = [(1, long, "a", "b", "c"), (1, long, "a", "b", "c"), (None, None, None, None, None)]
    assert sorted((r.licences, r.n_sentences) for r in L.scan(spark.createDataFrame(rows, schema)).collect()) == [("", 0), ("MIT", 200_001), ("MIT", 200_001)]
