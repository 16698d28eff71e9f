"""Licence scan by sentence rules.

Each sentence of a text is normalised and looked up among the known licence
sentences; the text becomes a sequence of sentence identifiers, and a licence is
found where the identifiers of one of its rules follow each other in order.
DataFrame functions throughout; no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, normalised: lower case, runs of other characters than a-z and 0-9 as one space.
SENTENCES: dict[str, str] = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-notice-3": "this project is licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-grant-head": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-long": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl2-notice": "licensed under the gnu general public license version 2",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-no-warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl-see": "see the gnu lesser general public license for more details",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "licensed under the bsd license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
}

#: A text without any of these has none of the sentences (tested).  Words may stand on different lines.
CUE = r"(?i)licen|permission|copyright|redistribut|warrant|free~software|public~domain|rights~reserved|merchantab|liable".replace("~", r"[^a-z0-9]+(?:(?:dnl|rem)[^a-z0-9]+)?")


@dataclass(frozen=True)
class Rule:
    """``sentences`` in this order, with up to ``gap`` other sentences between two of them."""

    name: str
    licence: str
    sentences: tuple[str, ...]
    gap: int = 0


RULES = (
    Rule("mit-notice", "MIT", ("mit-notice",)),
    Rule("mit-notice-2", "MIT", ("mit-notice-2",)),
    Rule("mit-notice-3", "MIT", ("mit-notice-3",)),
    Rule("mit-text", "MIT", ("mit-grant", "mit-warranty", "mit-liability"), 1),
    Rule("mit-text-lines", "MIT", ("mit-grant-head", "mit-condition", "mit-warranty", "mit-liability"), 1),
    Rule("apache-notice", "Apache-2.0", ("apache-notice",)),
    Rule("apache-header", "Apache-2.0", ("apache-notice-long", "apache-as-is", "apache-see"), 3),
    Rule("apache-header-lines", "Apache-2.0", ("apache-notice", "apache-comply", "apache-as-is", "apache-see"), 3),
    Rule("gpl3-notice", "GPL-3.0", ("gpl3-notice",)),
    Rule("gpl3-notice-2", "GPL-3.0", ("gpl3-notice-2",)),
    Rule("gpl2-notice", "GPL-2.0", ("gpl2-notice",)),
    Rule("gpl3-header", "GPL-3.0-or-later", ("gpl3-free", "gpl-no-warranty", "gpl-see"), 1),
    Rule("gpl2-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-no-warranty", "gpl-see"), 1),
    Rule("lgpl-header", "LGPL-2.1-or-later", ("lgpl-free", "lgpl-no-warranty", "lgpl-see"), 1),
    Rule("cc-by", "CC-BY-4.0", ("cc-by",)),
    Rule("cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa",)),
    Rule("cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc",)),
    Rule("cc-by-nd", "CC-BY-ND-4.0", ("cc-by-nd",)),
    Rule("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ("cc-by-nc-sa",)),
    Rule("cc-by-long", "CC-BY-4.0", ("cc-by-long",)),
    Rule("cc-by-sa-long", "CC-BY-SA-4.0", ("cc-by-sa-long",)),
    Rule("cc-by-nc-long", "CC-BY-NC-4.0", ("cc-by-nc-long",)),
    Rule("bsd-3", "BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names"), 3),
    Rule("bsd-2", "BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary"), 3),
    Rule("bsd-notice", "BSD", ("bsd-notice",)),
    Rule("isc-text", "ISC", ("isc-grant", "mit-warranty"), 1),
    Rule("mpl-notice", "MPL-2.0", ("mpl-notice",)),
    Rule("unlicense", "Unlicense", ("unlicense",)),
    Rule("cc0", "CC0-1.0", ("cc0",)),
    Rule("reserved", "proprietary", ("reserved",)),
    Rule("isc-license", "ISC", ("isc-grant", "isc-warranty", "isc-liability"), 1),
    Rule("apache-file", "Apache-2.0", ("apache-notice-long",)),
)

#: A line that goes on in lower case is one sentence with the line before, unless that ended.
UNWRAP = (r"([^.!?:\n])\n([a-z])", "\\1 \\2")
#: After these a sentence ends.
BREAK = (r"([.!?])[ \t\r\n\f]+", "\\1\n")
#: Comment signs that are words, and a list's letter or number, before the words of a line.
SIGN, ITEM = r"(?m)^[ \t]*(?:dnl|REM)\b[ \t]*", r"(?m)^[ \t]*\(?[0-9a-z]{1,2}\)[ \t]+"


def rule_pattern(rule: Rule, ids: dict[str, int]) -> str:
    """Regular expression over a sequence written ``,1,,0,,7,``."""
    return ("(?:,[0-9]+,){0,%d}" % rule.gap).join(f",{ids[s]}," for s in rule.sentences)


def paragraph_break(sentences: dict[str, str]) -> str:
    """Where a sentence of several lines cannot go on.  Each place is a break of the line reading too.

    After ``.``, ``!`` or ``?`` (not in ``v. 2.0``), before a line without words, after a
    colon before a line that doesn't go on in lower case, and before a line that opens
    with a capital and the first words of a known sentence.
    """
    heads = {tuple(s.split()[:3]) for s in sentences.values()}
    opening = "|".join(f"{h[0][0].upper()}(?i:{'[^A-Za-z0-9]+'.join((h[0][1:], *h[1:]))})" for h in sorted(heads))
    wordless = r"[^\p{L}\p{N}\n]*"
    return "|".join((
        r"(?<=[!?])[ \t\r\n\f]+", r"(?<=\.)(?<!\b(?i:v|ver|vers|no|nr)\.)[ \t\r\n\f]+", r"(?<=\.)[ \t\r\n\f]++(?![0-9])",
        rf"\n(?={wordless}\n)", rf"(?<=:)[ \t\r]*\n(?={wordless}[\p{{Lu}}\p{{N}}])", rf"\n(?={wordless}(?:{opening})(?![A-Za-z0-9]))",
    ))


def sequence(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifier numbers of a text's sentences (from 1; 0 if unknown), in order, written ``,1,,0,,7,``.

    A sentence over several lines, however they are wrapped, commented or indented, is
    one if it is known as a whole; otherwise each of its lines counts.
    """
    whole = F.regexp_replace(F.regexp_replace(text, SIGN, ""), UNWRAP[0], "$1 $2")
    known = F.create_map(*(F.lit(x) for i, s in enumerate(sentences.values(), 1) for x in (s, f",{i},")))
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))

    def by_line(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.regexp_replace(s, BREAK[0], "$1\n"), "\n"), plain), lambda x: x != "")
        return F.array_join(F.transform(lines, lambda x: F.coalesce(F.try_element_at(known, x), F.lit(",0,"))), "")

    of = lambda s: F.coalesce(F.try_element_at(known, plain(F.regexp_replace(s, ITEM, ""))), by_line(s))
    return F.array_join(F.transform(F.split(whole, paragraph_break(sentences)), of), "")


def licences(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sentences: dict[str, str] = SENTENCES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``documents`` and rule found: ``key, licence, rule, times``
    and ``sentence``, the place (from 0) of the first match among the row's sentences.

    ``times``: matches from left to right that do not overlap.  Null, empty and
    wordless texts match nothing; repeated rows and null keys are matched row by row.
    """
    ids = {s: i for i, s in enumerate(sentences, 1)}
    rows = documents.where(F.col(text).rlike(CUE)).select(F.col(key).alias("k"), sequence(F.col(text), sentences).alias("ids"))
    rows = rows.where(F.col("ids").rlike(",[1-9]"))
    found = []
    for r in rules:
        pattern = rule_pattern(r, ids)
        first = F.regexp_instr("ids", F.lit(pattern))
        before = F.substring(F.col("ids"), F.lit(1), first - 1)
        found.append(F.when(first > 0, F.struct(
            F.lit(r.licence).alias("licence"), F.lit(r.name).alias("rule"), F.regexp_count("ids", F.lit(pattern)).cast("long").alias("times"),
            F.regexp_count(before, F.lit("[0-9]+")).cast("long").alias("sentence"),
        )))
    each = rows.select("k", F.explode(F.array_compact(F.array(*found))).alias("f"))
    return each.select(F.col("k").alias(key), "f.licence", "f.rule", "f.times", "f.sentence")


def oracle(rules: tuple[Rule, ...] = RULES, sentences: dict[str, str] = SENTENCES) -> str:
    """The same in DuckDB's SQL for texts whose known sentences stand on one line each or go on in lower case."""
    ids = {s: i for i, s in enumerate(sentences, 1)}
    known = ", ".join(f"('{s}', {i})" for i, s in enumerate(sentences.values(), 1))
    ruled = ", ".join("('%s', '%s', '%s')" % (r.licence, r.name, rule_pattern(r, ids)) for r in rules)
    return f"""
WITH known(s, n) AS (VALUES {known}),
rules(licence, rule, pattern) AS (VALUES {ruled}),
lines AS (
  SELECT rid, doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([^.!?:\\n])\\n([a-z])', '\\1 \\2', 'g'), '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(10), 'g'), chr(10))) AS line,
         generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([^.!?:\\n])\\n([a-z])', '\\1 \\2', 'g'), '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS line_no
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
),
plain AS (SELECT rid, doc_id, line_no, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS s FROM lines),
sequences AS (
  SELECT rid, any_value(doc_id) AS doc_id, string_agg(',' || coalesce(n, 0)::VARCHAR || ',', '' ORDER BY line_no) AS ids
  FROM plain LEFT JOIN known USING (s) WHERE s <> '' GROUP BY rid HAVING count(n) > 0
)
SELECT doc_id, licence, rule, len(regexp_extract_all(ids, pattern))::BIGINT AS times,
       len(regexp_extract_all(regexp_extract(ids, '^(.*?)' || pattern, 1), '[0-9]+'))::BIGINT AS sentence
FROM sequences, rules WHERE regexp_matches(ids, pattern)"""
