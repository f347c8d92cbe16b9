"""Folding and stemming in SQL, for the oracle of the stemmed search keys.

The measure of a stem is read off regular expressions over runs of consonants
and vowels (an initial y is marked as the consonant Y), where the operator
counts them letter by letter; the suffix tables are the algorithm's own.
"""

from __future__ import annotations

from ..functions.tokens import _STEP2, _STEP3, _STEP4

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_CVC = "([^aeiouy]|[aeiou]y)[aeiouy][^aeiouwxyY]$"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _m_above(x: str, n: int) -> str:
    return _has(x, f"^({_C})?" + f"({_V}{_C})" * (n + 1))


def _m_is_one(x: str) -> str:
    return _has(x, f"^({_C})?{_V}{_C}({_V})?$")


def _vowel(x: str) -> str:
    return _has(x, f"^({_C})?[aeiouy]")


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _double(x: str) -> str:
    return f"(right({x}, 1) = substr({x}, -2, 1) AND {_has(x, '[^aeiouy]$')})"


def _suffixes(rules, holds) -> str:
    whens = " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {holds(s, _cut(len(s)))} THEN {_cut(len(s))} || '{r}' ELSE w END"
                     for s, r in rules)
    return f"CASE {whens} ELSE w END"


def _steps() -> list[str]:
    plural = ("CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN " + _cut(2) + " WHEN ends_with(w, 'ss') THEN w "
              f"WHEN ends_with(w, 's') THEN {_cut(1)} ELSE w END")
    past = (f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m_above(_cut(3), 0)} THEN {_cut(1)} ELSE w END "
            f"WHEN ends_with(w, 'ed') AND {_vowel(_cut(2))} THEN {_cut(2)} || '+' "
            f"WHEN ends_with(w, 'ing') AND {_vowel(_cut(3))} THEN {_cut(3)} || '+' ELSE w END")
    s = _cut(1)                                     # the stem before the mark "+"
    mend = (f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN {_has(s, '(at|bl|iz)$')} THEN {s} || 'e' "
            f"WHEN {_double(s)} AND NOT {_has(s, '[lsz]$')} THEN {_cut(2)} "
            f"WHEN {_m_is_one(s)} AND {_has(s, _CVC)} THEN {s} || 'e' ELSE {s} END")
    final_y = f"CASE WHEN ends_with(w, 'y') AND {_vowel(s)} THEN {s} || 'i' ELSE w END"
    above_0 = lambda suf, stem: _m_above(stem, 0)
    step_4 = lambda suf, stem: _m_above(stem, 1) + (f" AND {_has(stem, '[st]$')}" if suf == "ion" else "")
    final_e = f"CASE WHEN ends_with(w, 'e') AND ({_m_above(s, 1)} OR {_m_is_one(s)} AND NOT {_has(s, _CVC)}) THEN {s} ELSE w END"
    final_l = f"CASE WHEN {_m_above('w', 1)} AND ends_with(w, 'll') THEN {s} ELSE w END"
    return [plural, past, mend, final_y, _suffixes(_STEP2, above_0), _suffixes(_STEP3, above_0),
            _suffixes([(x, "") for x in _STEP4], step_4), final_e, final_l]


def stem_ctes(words: str, out: str) -> str:
    """CTE ``out`` (term, w): the folded stems of the distinct terms of ``words``."""
    first = (f"{out}_0 AS (SELECT term, strip_accents(term) AS f FROM (SELECT DISTINCT term FROM {words})),\n"
             f"{out}_w0 AS (SELECT term, CASE WHEN f[1] = 'y' THEN 'Y' || f[2:] ELSE f END AS w FROM {out}_0 "
             f"WHERE regexp_full_match(f, '[a-z]{{3,}}'))")
    steps = [f"{out}_w{i} AS (SELECT term, {e} AS w FROM {out}_w{i - 1})" for i, e in enumerate(_steps(), 1)]
    last = f"{out} AS (SELECT z.term, coalesce(lower(s.w), z.f) AS w FROM {out}_0 z LEFT JOIN {out}_w{len(steps)} s ON s.term = z.term)"
    return ",\n".join([first, *steps, last])
