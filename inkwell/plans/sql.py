"""Pieces of DuckDB SQL for the column functions, made from the same profiles, for checking results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from inkwell.functions.profiles import Profile
from inkwell.functions.text import EDGES, HAN_GAP


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words: Iterable[str]) -> str:
    return "(" + ", ".join(map(lit, words)) + ")"


TEXT = "coalesce(text, '')"


def clean(t: str) -> str:
    t = f"replace({t}, chr(173), '')"
    for _ in range(2):
        t = rf"regexp_replace({t}, {lit(HAN_GAP)}, '\1\2', 'g')"
    return t


def pieces(t: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, {lit(pattern)}), lambda s: regexp_replace(s, {lit(EDGES)}, '', 'g')), lambda s: s <> '')"


def sentences(t: str, p: Profile) -> str:
    return pieces(t, p.sentence)


def tokens(t: str, p: Profile) -> str:
    return f"regexp_extract_all(lower({t}), {lit(p.token)})"


def sentence_tokens(t: str, p: Profile) -> str:
    return f"list_transform({sentences(t, p)}, lambda x: {tokens('x', p)})"


def letters(t: str, p: Profile) -> str:
    return f"length(regexp_replace({t}, {lit(p.letter)}, '', 'g'))"


def occurrences(words: str, wanted: Sequence[str]) -> str:
    return f"len(list_filter({words}, lambda w: w IN {among(wanted)}))" if wanted else "0"


def ratio(a: str, b: str) -> str:
    return f"round(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 6)"


def per_thousand(a: str, b: str) -> str:
    return f"round(1000::DOUBLE * ({a}) / nullif({b}, 0), 6)"


def mask(t: str, p: Profile) -> str:
    for phrase in p.masks:
        t = f"replace({t}, {lit(phrase)}, {lit('#' * len(phrase))})"
    return t


def body(t: str, p: Profile) -> str:
    return f"array_to_string(list_filter(string_split_regex({t}, {lit(p.paragraph)}), lambda x: NOT regexp_matches(x, {lit(p.routine)})), chr(10))"


def hits(words: str, p: Profile, reach: int) -> str:
    """From a list of sentences' tokens."""
    entry = f"{{'word': w, 'sign': CASE WHEN w IN {among(p.positive)} THEN 1 ELSE -1 END, 'flipped': len(list_filter(ws[greatest(i - {reach}, 1):i - 1], lambda v: v IN {among(p.negators)})) % 2 = 1}}"
    return f"flatten(list_transform({words}, lambda ws: list_filter(list_transform(ws, lambda w, i: {entry}), lambda h: h.word IN {among(p.positive + p.negative)})))"


def values(rows: Sequence[Sequence], names: str) -> str:
    cell = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"
