"""Multi-vocabulary keyword matching in one pass per text.

Spark has no multi-pattern substring primitive: the literal form tests every
keyword with its own ``contains`` (cost keywords x text length, ~190 scans of
each description for the facility lists).  The automaton engine builds one
Aho-Corasick automaton over all vocabularies and scans each text once inside an
Arrow UDF, returning for every ordered vocabulary the keyword
with the lowest priority found anywhere in the text (= first match in
declaration order) and for every unordered vocabulary whether any word occurs.

Texts are lower-cased JVM-side before the UDF; only the lowered text crosses to
Python.  Both engines give identical results (tested).  The engine is an argument:
``automaton`` needs pyahocorasick wherever tasks run, ``columns`` needs nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rulejoin import first_match_by_table  # noqa: F401 - the form for rules held in a table
from .rules import any_match, first_match_keyword, ordered_rules
from .vocab import distinct_in_order

ENGINE = "automaton"


_AUTOMATA: dict[tuple, object] = {}


def _automaton(ordered: dict[str, list[str]], unordered: dict[str, list[str]]):
    """The automaton, and a function from what it finds in a text to the values of all vocabularies.

    A word's payload is a number with a bit for each vocabulary entry that it is: first one
    a name of ``unordered``, then one a keyword of each ordered list, in its order.  What a
    text holds is the OR of its words' numbers.  Built once per Python worker."""
    key = (tuple((k, tuple(v)) for k, v in ordered.items()), tuple((k, tuple(v)) for k, v in unordered.items()))
    made = _AUTOMATA.get(key)
    if made is None:
        import ahocorasick

        payload: dict[str, int] = {}
        for j, name in enumerate(unordered):
            for w in unordered[name]:
                payload[w] = payload.get(w, 0) | 1 << j
        sections, at = [], len(unordered)
        for words in ordered.values():
            sections.append((words, at))
            for i, w in enumerate(words):
                payload[w] = payload.get(w, 0) | 1 << at + i
            at += len(words)

        def values(bits: int | None) -> list:
            if bits is None:
                return [None] * (len(ordered) + len(unordered))
            out = []
            for words, start in sections:
                mine = bits >> start & (1 << len(words)) - 1
                out.append(words[(mine & -mine).bit_length() - 1] if mine else None)
            return out + [bool(bits >> j & 1) for j in range(len(unordered))]

        a = ahocorasick.Automaton()
        for w, bits in payload.items():
            a.add_word(w, bits)
        a.make_automaton()
        made = _AUTOMATA[key] = (a, values)
    return made


def match_struct(text_lc: Column, ordered: dict[str, list[str]], unordered: dict[str, list[str]]) -> Column:
    """One pass over ``text_lc``: struct with ``<name>`` = first keyword of each
    ordered list (null if none) and ``<name>`` = any-match boolean of each
    unordered list (null for a null text)."""
    ordered = {k: [w for w in v] for k, v in ordered.items()}
    unordered = {k: distinct_in_order(v) for k, v in unordered.items()}
    names, n_o = [*ordered, *unordered], len(ordered)
    schema = "struct<" + ", ".join(f"`{n}`: {'string' if j < n_o else 'boolean'}" for j, n in enumerate(names)) + ">"

    @F.arrow_udf(schema)
    def match(texts: pa.Array) -> pa.Array:
        a, values = _automaton(ordered, unordered)
        empty = a.kind == 0  # finds nothing, and cannot be asked
        # what a text holds, and the number of it among what the batch's texts hold
        seen: dict[int | None, int] = {}
        place = []
        for t in texts.to_pylist():
            bits = None if t is None else 0
            if t is not None and not empty:
                for _, found in a.iter(t):
                    bits |= found
            place.append(seen.setdefault(bits, len(seen)))
        rows, at = [values(bits) for bits in seen], pa.array(place, pa.int32())
        kinds = [pa.string() if j < n_o else pa.bool_() for j in range(len(names))]
        return pa.StructArray.from_arrays([pa.array([r[j] for r in rows], kind).take(at) for j, kind in enumerate(kinds)], names=names)

    return match(text_lc)


def match_columns(
    text_lc: Column,
    ordered: dict[str, list[tuple[str, str]]],
    unordered: dict[str, list[str]],
    engine: str = ENGINE,
) -> dict[str, Column]:
    """Columns ``{name: first keyword | any-match flag}`` for the vocabularies.

    With the automaton engine every column is a field of one UDF result, so
    the caller should project the struct once (see :func:`with_matches`)."""
    if engine not in ("automaton", "columns"):
        raise ValueError(f"unknown engine {engine!r}: automaton or columns")
    if engine == "automaton":
        s = match_struct(text_lc, {k: [kw for kw, _ in ordered_rules(v)] for k, v in ordered.items()}, unordered)
        return {"__struct__": s}
    cols = {k: first_match_keyword(text_lc, v) for k, v in ordered.items()}
    cols.update({k: any_match(text_lc, v) for k, v in unordered.items()})
    return cols
