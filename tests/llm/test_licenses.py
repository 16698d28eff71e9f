"""Licence scan: rules over sentence sequences, against the SQL form and by hand."""

import re

import pytest

from kindsort.llm import licenses

SCHEMA = "doc_id long, text string"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

The software is provided "as is", without warranty of any kind, express or
implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. In no event shall the
authors or copyright holders be liable for any claim, damages or other
liability, whether in an action of contract, tort or otherwise, arising from,
out of or in connection with the software or the use or other dealings in the
software."""


def found(df):
    return sorted(((r["doc_id"], r["rule"], r["times"], r["sentence"]) for r in licenses.licences(df).collect()), key=str)


def test_known_sentences_are_normal_and_have_a_cue():
    cue = re.compile(licenses.CUE)
    for s in licenses.SENTENCES.values():
        assert re.sub("[^a-z0-9]+", " ", s.lower()).strip() == s
        assert cue.search(s), s
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert {s for r in licenses.RULES for s in r.sentences} <= set(licenses.SENTENCES)


def test_notices_and_full_text(make):
    rows = [
        (1, "Blah blah.\nReleased under the MIT License.\nMore."),
        (2, MIT),
        (3, "LICENSED  UNDER, cc by-nc 4.0!"),
        (4, "It is not licensed under CC BY-NC 4.0 at all."),
        (5, "Licensed under CC BY 4.0. x. Licensed under CC BY 4.0."),
    ]
    assert found(make(rows, SCHEMA)) == [(1, "mit-notice", 1, 1), (2, "mit-text-lines", 1, 0), (3, "cc-by-nc", 1, 0), (5, "cc-by", 2, 0)]


def test_order_and_gaps(make):
    a, b, c = (MIT.split("\n\n")[i] for i in range(3))
    rows = [(1, "\n\n".join((a, "By us.", b, c))), (2, "\n\n".join((b, a, c))), (3, "\n\n".join((a, "One.", "Two.", b, c)))]
    assert [r[:2] for r in found(make(rows, SCHEMA))] == [(1, "mit-text-lines")]


def test_odd_rows(make):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "license"), (None, mit), (5, mit), (5, mit), (6, "Word word.\n" * 20_000 + mit)]
    df = make(rows, SCHEMA).selectExpr("*", "1 as rule", "2 as ids", "3 as k")
    assert found(df) == sorted([(None, "mit-notice", 1, 0), (5, "mit-notice", 1, 0), (5, "mit-notice", 1, 0), (6, "mit-notice", 1, 20_000)], key=str)
    assert found(make([], SCHEMA)) == []


def test_native(make):
    plan = licenses.licences(make([(1, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", [MIT, "Foo\nbar. All rights reserved.\nAll rights reserved.", "a\nb\nc license all rights reserved."])
def test_sql_form(make, text):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, ?::VARCHAR AS text", [text])
    assert sorted((r[0], r[2], r[3], r[4]) for r in con.execute(licenses.oracle()).fetchall()) == found(make([(1, text)], SCHEMA))


#: As their owners print them.
PRINTED = {
    "MIT": """MIT License

Copyright (c) 2020 Jane Roe

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
    "Apache-2.0": """Copyright 2020 Jane Roe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "GPL-3.0-or-later": """Copyright (C) 2020  Jane Roe

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "GPL-2.0-or-later": """Copyright (C) 2020  Jane Roe

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "LGPL-2.1-or-later": """Copyright (C) 2020  Jane Roe

This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "BSD-3-Clause": """Copyright (c) 2020, Jane Roe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "ISC": """Copyright (c) 2020, Jane Roe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
""",
}


def test_printed_texts_in_any_layout(make):
    import textwrap

    dense = {k: "\n".join(x for x in t.split("\n") if x.strip()) for k, t in PRINTED.items()}  # no blank lines
    rows = []
    for by in (lambda t: t, lambda t: textwrap.indent(t, "# ", bool), lambda t: "/*\n" + textwrap.indent(t, " * ", bool) + " */", lambda t: textwrap.indent(t, "// ", bool), lambda t: textwrap.indent(t, "dnl ", bool), lambda t: t.replace("\n", "\r\n")):
        rows += [(k, by(t)) for k, t in PRINTED.items()]
    for width in (30, 50, 100):
        rows += [(k, "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))) for k, t in PRINTED.items()]
    rows += list(dense.items())
    got: dict[int, set[str]] = {}
    for r in licenses.licences(make([(i, t) for i, (_, t) in enumerate(rows)], SCHEMA)).collect():
        got.setdefault(r["doc_id"], set()).add(r["licence"])
    missed = [(i, k, got.get(i)) for i, (k, _) in enumerate(rows) if got.get(i, set()) - {"BSD-2-Clause"} != {k}]
    assert not missed


def test_cue_over_lines(make):
    assert [r[1] for r in found(make([(1, "This is free and\n# unencumbered software released into the public\n# domain."), (2, "All rights\n// reserved."), (3, "dnl All rights\ndnl reserved.")], SCHEMA))] == ["unlicense", "reserved", "reserved"]


def test_lines_that_are_no_sentence_still_count_alone(make):
    rows = [(1, "Title\nLicensed under the MIT License\nOther Line"), (2, "# A\n# All rights reserved.\n# B")]
    assert found(make(rows, SCHEMA)) == [(1, "mit-notice-2", 1, 1), (2, "reserved", 1, 1)]
