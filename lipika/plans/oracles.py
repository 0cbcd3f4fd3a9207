"""DuckDB SQL for the scheme engine, written with joins and windows instead of array expressions, over values of its own."""

from __future__ import annotations

import re

from . import scheme_values as V

LATIN = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_of(values) -> str:
    return "|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v)))


def any_code(lang: str) -> str:
    return _any_of(V.native(lang))


def symbol_values(lang: str) -> str:
    found = [f"({_q(name)}, '{kind}', {_q(code)}, {_q(letter or '')})" for name, (_, kind, code, letter) in V.spelled(lang).items()]
    return f"(VALUES {', '.join(found)})"


def tokens_cte(lang: str, words: str = "latin", tok: str = "tok") -> str:
    pattern = f"(?:{_any_of(V.spelled(lang))})|(?s:.)"
    whole = "word" if lang in V.NO_OUM else "regexp_replace(word, '^(oum)$', 'OM')"
    return f"""{tok} AS (SELECT word, unnest(parts) AS t, generate_subscripts(parts, 1) AS i
      FROM (SELECT word, regexp_extract_all({whole}, {_q(pattern)}) AS parts FROM {words}))"""


def forms_cte(lang: str, words: str = "latin", forms: str = "forms") -> str:
    """CTEs that end with ``forms(word, form)`` for the words of a CTE."""
    virama, x = _q(V.halanth(lang)), forms
    final = f"|| CASE WHEN coalesce(nx, 'other') = 'other' AND (k = 'cons' OR (k = 'nukta' AND p = 'cons')) THEN {virama} ELSE '' END" if lang in V.FINAL_HALANTH else ""
    return f"""{tokens_cte(lang, words, x + '_tok')},
    {x}_cls AS (SELECT word, i, s.t AS t, coalesce(m.k, 'other') AS k, coalesce(m.code, s.t) AS code, m.letter AS letter
      FROM {x}_tok s LEFT JOIN {symbol_values(lang)} m(t, k, code, letter) ON s.t = m.t),
    {x}_ctx AS (SELECT *, lag(k) OVER w AS p, lag(k, 2) OVER w AS pp, lead(k) OVER w AS nx FROM {x}_cls WINDOW w AS (PARTITION BY word ORDER BY i)),
    {x}_put AS (SELECT *, coalesce(p = 'cons' OR (p = 'nukta' AND pp = 'cons'), false) AS after FROM {x}_ctx),
    {x} AS (SELECT word, string_agg(CASE
        WHEN k = 'cons' THEN CASE WHEN after THEN {virama} ELSE '' END || code
        WHEN k = 'vowel' THEN CASE WHEN after THEN code ELSE letter END
        WHEN k = 'nukta' THEN CASE WHEN p = 'cons' THEN code ELSE '' END
        WHEN k = 'joiner' THEN CASE WHEN p = 'halanth' THEN code ELSE {virama} || code END
        WHEN k = 'delim' THEN CASE WHEN p = 'vowel' THEN '' ELSE code END
        ELSE code END {final}, '' ORDER BY i) AS form FROM {x}_put GROUP BY word)"""


def spellings_cte(lang: str) -> str:
    """CTEs that end with ``spellings(word, k, s)``: the k-th scheme spelling of each native word, without ``/`` where with them it reads the same."""
    values = ", ".join(f"({_q(c)}, '{kind}', [{', '.join(map(_q, names))}])" for c, (kind, names) in V.native(lang).items())
    pattern = _q(f"(?:{_any_of(V.native(lang))})|(?s:.)")
    final = lang in V.FINAL_HALANTH
    silent = "k = 'halanth' AND (nx = 'cons'" + (" OR nx IS NULL)" if final else ")")
    alone = "nx IS NULL" if final else "nx IS NULL AND p IS NULL"
    return f"""{native_cte(lang)},
    code AS (SELECT word, unnest(parts) AS c, generate_subscripts(parts, 1) AS i FROM (SELECT word, regexp_extract_all(word, {pattern}) AS parts FROM native)),
    named AS (SELECT code.word, code.i, m.k, coalesce(m.names, [code.c]) AS names FROM code LEFT JOIN (VALUES {values}) m(c, k, names) ON code.c = m.c),
    beside AS (SELECT *, lag(k) OVER w AS p, lag(k, 2) OVER w AS pp, lead(k) OVER w AS nx, max(len(names)) OVER (PARTITION BY word) AS most FROM named WINDOW w AS (PARTITION BY word ORDER BY i)),
    turn AS (SELECT *, unnest(range(1, most + 1)) AS turn FROM beside),
    spelt AS (SELECT word, turn, string_agg(
        CASE WHEN k = 'vowel' AND (p IN ('vowel', 'sign', 'cons') OR (p = 'nukta' AND pp = 'cons')) THEN '/' ELSE '' END
        || CASE WHEN {silent} THEN '' ELSE names[least(turn, len(names))] END
        || CASE WHEN k = 'cons' AND (nx IN ('cons', 'dot', 'vowel') OR ({alone})) THEN 'a' ELSE '' END, '' ORDER BY i) AS s FROM turn GROUP BY word, turn),
    asked AS (SELECT DISTINCT s AS word FROM spelt),
    {forms_cte(lang, "asked", "again")},
    spellings AS (SELECT spelt.word, turn, CASE WHEN again.form = spelt.word THEN replace(s, '/', '') ELSE s END AS s FROM spelt LEFT JOIN again ON again.word = spelt.s)"""


def native_cte(lang: str) -> str:
    """CTEs that end with ``native(word, n)``: the corpus's words in native script."""
    return f"latin AS ({LATIN}), {forms_cte(lang)}, native AS (SELECT form AS word, CAST(sum(n) AS BIGINT) AS n FROM latin JOIN forms USING (word) WHERE form <> '' GROUP BY form)"


def class_of(lang: str, kind: str) -> str:
    found = "".join(sorted(c for c, (k, _) in V.native(lang).items() if len(c) == 1 and k == kind))
    return f"[{found}]" if found else "[^\\s\\S]"


def syllable_pattern(lang: str) -> str:
    c, n, h, s, d, v, digit = (class_of(lang, k) for k in ("cons", "nukta", "halanth", "sign", "dot", "vowel", "digit"))
    j = "[\u200c\u200d]?"
    tail = f"({h}{j}$|{s}?{d}?)?" if lang in V.FREE_DOT else f"({s}{d}?|{h}{j}$)?"
    return f"{v}{d}?|{c}{n}?(?:{h}{j}{c}{n}?){{0,3}}{tail}|{digit}".replace("(?:", "(").replace("(", "(?:")


def simple_pattern(lang: str) -> str:
    c, n, h, s, d, v = (class_of(lang, k) for k in ("cons", "nukta", "halanth", "sign", "dot", "vowel"))
    return f"^{v}{d}?$|^{c}{n}?(?:{d}|{s}|{h}[\u200c\u200d]?)?$"


def syllables_cte(lang: str) -> str:
    """CTEs that end with ``syl(word, n, i, akshara)``."""
    known = "".join(sorted(c for c in V.native(lang) if len(c) == 1))
    pattern = _q(syllable_pattern(lang))
    return f"""{native_cte(lang)}, syl AS (SELECT word, n, unnest(parts) AS akshara, generate_subscripts(parts, 1) AS i
      FROM (SELECT word, n, regexp_extract_all(regexp_replace(word, '[^{known}]', '', 'g'), {pattern}) AS parts FROM native))"""


def bigrams_cte(lang: str) -> str:
    """CTEs that end with ``bi(key, prev, akshara, simple, n)``."""
    return f"""{syllables_cte(lang)},
    pairs AS (SELECT coalesce(lag(akshara) OVER (PARTITION BY word ORDER BY i), '^') AS prev, akshara, n FROM syl),
    bi AS (SELECT akshara[1] AS key, prev, akshara, regexp_matches(akshara, {_q(simple_pattern(lang))}) AS simple, CAST(sum(n) AS BIGINT) AS n
      FROM pairs GROUP BY ALL)"""


def top_cte(lang: str, k: int = 15) -> str:
    """CTEs that end with ``scored(key, prev, akshara, simple, n, rank, score)``."""
    return f"""{bigrams_cte(lang)},
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, prev ORDER BY n DESC, akshara) AS rank FROM bi) WHERE rank <= {k}),
    scored AS (SELECT *, round(10 * log10(n) / greatest(0.1, max(log10(n)) OVER (PARTITION BY key, prev))) AS score FROM top)"""
