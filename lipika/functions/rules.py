"""Scheme tables: Latin spellings and the code points they stand for, in ten languages.

The Indic blocks of Unicode are laid out alike, so one Devanagari table serves all: a language has
the first code point of its block, rows of its own, and rows that it lacks. A symbol whose code
point the block has not is written with a substitute or is absent.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache

#: The zero-width joiner and non-joiner, as a regular expression.
JOINERS = "[\u200c\u200d]"
CONS, VOWEL, SIGN, DOT, HALANTH, NUKTA, JOINER, DELIM, DIGIT, SPECIAL, OTHER = "cons", "vowel", "sign", "dot", "halanth", "nukta", "joiner", "delim", "digit", "special", "other"

# Spellings (the first is the usual one), class, and Devanagari code.
SYMBOLS: list[tuple[list[str], str, str]] = [
    (["k"], CONS, "क"),
    (["kh", "K"], CONS, "ख"),
    (["g"], CONS, "ग"),
    (["gh", "G"], CONS, "घ"),
    (["~N"], CONS, "ङ"),
    (["ch"], CONS, "च"),
    (["chh", "Ch", "CH"], CONS, "छ"),
    (["j"], CONS, "ज"),
    (["jh", "Jh", "JH"], CONS, "झ"),
    (["~n"], CONS, "ञ"),
    (["T"], CONS, "ट"),
    (["Th", "TH"], CONS, "ठ"),
    (["D"], CONS, "ड"),
    (["Dh"], CONS, "ढ"),
    (["N"], CONS, "ण"),
    (["t"], CONS, "त"),
    (["th"], CONS, "थ"),
    (["d"], CONS, "द"),
    (["dh"], CONS, "ध"),
    (["n"], CONS, "न"),
    (["p"], CONS, "प"),
    (["ph", "f"], CONS, "फ"),
    (["b"], CONS, "ब"),
    (["bh"], CONS, "भ"),
    (["m"], CONS, "म"),
    (["y"], CONS, "य"),
    (["r"], CONS, "र"),
    (["l"], CONS, "ल"),
    (["L"], CONS, "ळ"),
    (["v", "w"], CONS, "व"),
    (["sh", "S"], CONS, "श"),
    (["Sh", "SH"], CONS, "ष"),
    (["s"], CONS, "स"),
    (["h"], CONS, "ह"),
    (["q"], CONS, "क़"),
    (["J"], CONS, "ज़"),
    (["x"], CONS, "क्ष"),
    (["GY"], CONS, "ज्ञ"),
    (["R"], CONS, "ऱ"),
    ([".n", ".m"], DOT, "ं"),
    (["H"], DOT, "ः"),
    ([".N"], DOT, "ँ"),
    ([".a"], DOT, "ऽ"),
    (["OM"], SPECIAL, "ॐ"),
    (["^"], JOINER, "\u200d"),
    (["^^"], JOINER, "\u200c"),
    (["/"], DELIM, "्\u200c"),
    ([".h"], HALANTH, "्"),
    ([".x"], NUKTA, "़"),
]
# Spellings, sign (after a consonant), and letter (elsewhere; None: there is none).
VOWELS: list[tuple[list[str], str, str | None]] = [
    (["a"], "", "अ"),
    (["A", "aa"], "ा", "आ"),
    (["i"], "ि", "इ"),
    (["I", "ii", "ee"], "ी", "ई"),
    (["u"], "ु", "उ"),
    (["U", "oo"], "ू", "ऊ"),
    (["RRi"], "ृ", "ऋ"),
    (["RRI"], "ॄ", "ॠ"),
    (["e", "E"], "े", "ए"),
    (["ai"], "ै", "ऐ"),
    (["o", "O"], "ो", "ओ"),
    (["au", "ou"], "ौ", "औ"),
    ([".c"], "ॅ", None),
    ([".C"], "ॉ", "ऑ"),
]
# In these blocks short and long e and o are different letters.
SHORT_AND_LONG: list[tuple[list[str], str, str]] = [
    (["e"], "ॆ", "ऎ"),
    (["E"], "े", "ए"),
    (["o"], "ॊ", "ऒ"),
    (["O"], "ो", "ओ"),
]
# Rows that take the place of the row with their first spelling, or are added; (spellings, class, Devanagari code), codes of other blocks as they are.
OWN_SYMBOLS: dict[str, list[tuple[list[str], str, str]]] = {
    "marathi": [
        (["k", "q"], CONS, "क"),
        (["RR"], CONS, "ऱ"),
        ([".c"], DOT, "ॅ"),
    ],
    "nepali": [
        ([".Da"], CONS, "ड़"),
        ([".Dha"], CONS, "ढ़"),
        (["Ya"], CONS, "य़"),
    ],
    "punjabi": [
        (["khh", "Kh"], CONS, "ख़"),
        (["ghh", "Gh"], CONS, "ग़"),
        (["x"], CONS, "क्श"),
        (["R"], CONS, "\u095c"),
        (["Fa"], CONS, "फ़"),
        ([".a"], SPECIAL, "\u0a71"),
        (["OM"], SPECIAL, "\u0a74"),
    ],
    "tamil": [
        (["k", "g"], CONS, "क"),
        (["~N", "NG"], CONS, "ङ"),
        (["c", "ch"], CONS, "च"),
        (["j", "jh"], CONS, "ज"),
        (["T", "D"], CONS, "ट"),
        (["t", "th", "d"], CONS, "त"),
        (["Nn"], CONS, "\u0929"),
        (["f", "ph"], CONS, "ःप"),
        (["b"], CONS, "प"),
        (["zh"], CONS, "\u0934"),
        (["J"], CONS, "ज"),
        (["H", "q"], DOT, "ः"),
        ([".x"], NUKTA, ""),
        (["OM"], SPECIAL, "\u0950"),
    ],
    "telugu": [
        (["k", "q"], CONS, "क"),
        (["J"], CONS, "ज\u0cbc"),
        (["OM"], SPECIAL, "\u0950"),
    ],
    "kannada": [
        (["k", "q"], CONS, "क"),
        (["OM"], SPECIAL, "\u0950"),
    ],
    "malayalam": [
        (["k", "q"], CONS, "क"),
        (["zh"], CONS, "\u0934"),
        (["OM"], SPECIAL, "\u0950"),
    ],
}
# The same for vowels; (spellings, sign, letter).
OWN_VOWELS: dict[str, list[tuple[list[str], str, str]]] = {
    "marathi": [(["LLi"], "ॢ", "ऌ"), (["LLI"], "ॣ", "ॡ")],
    "nepali": [(["LLi"], "ॢ", "ऌ"), (["LLI"], "ॣ", "ॡ")],
    "malayalam": [(["RRI"], "", "ॠ"), (["LLi"], "", "ऌ"), (["LLI"], "", "ॡ")],
}
# First spellings of common rows that a language does not have.
WITHOUT = {
    "marathi": ["q", "R"],
    "bengali": ["OM"],
    "punjabi": ["q", "Sh", "RRi", "RRI", ".c", ".C"],
    "tamil": ["kh", "g", "gh", "ch", "chh", "jh", "Th", "D", "Dh", "th", "d", "dh", "ph", "bh", "q", ".N", ".a", "RRi", "RRI", ".c", ".C"],
    "telugu": ["q", ".N", ".a", ".c", ".C"],
    "kannada": ["q", ".N", ".a", ".c", ".C"],
    "malayalam": ["J", "q", ".N", ".a", ".c", ".C"],
}
#: Codes that stay where they are when a row moves to a language's block.
FIXED = {"\u0a71", "\u0a74", "\u0950", "\u0cbc"}


@dataclass(frozen=True)
class Language:
    """One language's block and switches. ``instead``: letters whose code point the block lacks, and the spelling that is written for them."""

    name: str
    base: int
    final_halanth: bool = False
    dot_needs_sign: bool = True
    zwj_significant: bool = False
    zwnj_significant: bool = True
    short_and_long: bool = False
    oum: bool = True
    instead: dict[str, str] = field(default_factory=dict, hash=False)


LANGUAGES = {
    x.name: x
    for x in (
        Language("hindi", 0x0900),
        Language("marathi", 0x0900),
        Language("nepali", 0x0900, dot_needs_sign=False),
        Language("bengali", 0x0980, oum=False, instead={"v": "b", "L": "l"}),
        Language("punjabi", 0x0A00, dot_needs_sign=False),
        Language("gujarati", 0x0A80),
        Language("tamil", 0x0B80, final_halanth=True, zwnj_significant=False, short_and_long=True),
        Language("telugu", 0x0C00, final_halanth=True, dot_needs_sign=False, short_and_long=True),
        Language("kannada", 0x0C80, final_halanth=True, short_and_long=True),
        Language("malayalam", 0x0D00, final_halanth=True, short_and_long=True),
    )
}


@dataclass(frozen=True)
class Symbol:
    """``code`` after a consonant is a sign's; ``letter`` is the vowel's elsewhere."""

    aliases: tuple[str, ...]
    kind: str
    code: str
    letter: str = ""
    order: int = 0


def _moved(text: str, of: Language, own: bool) -> str | None:
    """Devanagari text in a language's block; None if that block lacks one of its code points. In a language's own rows OM and the like stay."""
    out = []
    for c in text:
        x = chr(ord(c) - 0x0900 + of.base) if 0x0900 <= ord(c) < 0x0980 and not (own and c in FIXED) else c
        if unicodedata.category(x) == "Cn":
            return None
        out.append(x)
    return "".join(out)


def _rows(common: list, own: list, without: list[str]) -> list[tuple[tuple, bool]]:
    """Common rows, a language's own in their place, and the rest of its own; each with whether it is its own."""
    mine = {row[0][0]: row for row in own}
    out = [(mine.pop(row[0][0]), True) if row[0][0] in mine else (row, False) for row in common if row[0][0] in mine or row[0][0] not in without]
    return out + [(row, True) for row in mine.values()]


@cache
def symbols(lang: str) -> list[Symbol]:
    """All symbols of a language, in table order."""
    of = LANGUAGES[lang]
    plain = {aliases[0]: code for aliases, _, code in SYMBOLS}
    out = []
    for (aliases, kind, code), own in _rows(SYMBOLS, OWN_SYMBOLS.get(lang, []), WITHOUT.get(lang, [])):
        moved = _moved(code, of, own)
        if moved is None and aliases[0] in of.instead:
            moved = _moved(plain[of.instead[aliases[0]]], of, own)
        if moved is not None:
            out.append(Symbol(tuple(aliases), kind, moved, order=len(out)))
    for n in range(10):
        digit = chr(of.base + 0x66 + n)
        out.append(Symbol((str(n),), DIGIT, digit if unicodedata.category(digit) == "Nd" else str(n), order=len(out)))
    vowels = [v for v in VOWELS if not of.short_and_long or v[0][0] not in ("e", "o")] + (SHORT_AND_LONG if of.short_and_long else [])
    for (aliases, sign, letter), own in _rows(vowels, OWN_VOWELS.get(lang, []), WITHOUT.get(lang, [])):
        mark, full = _moved(sign, of, own), None if letter is None else _moved(letter, of, own)
        if mark is not None and (full is not None or letter is None):
            out.append(Symbol(tuple(aliases), VOWEL, mark, full or "", order=len(out)))
    return out


def halanth(lang: str) -> str:
    return chr(LANGUAGES[lang].base + 0x4D)


@cache
def native_codes(lang: str) -> dict[str, tuple[str, Symbol]]:
    """Code → (class, symbol) for reading native text; of symbols with one code the last listed wins."""
    out: dict[str, tuple[str, Symbol]] = {}
    for s in symbols(lang):
        if s.kind == VOWEL:
            if s.code:
                out[s.code] = (SIGN, s)
            if s.letter:
                out[s.letter] = (VOWEL, s)
        else:
            if s.code:
                out[s.code] = (s.kind, s)
    return out


def any_of(values) -> str:
    """A regular expression for the longest of some strings."""
    import re

    return "|".join(re.escape(v) for v in sorted(values, key=lambda v: (-len(v), v)))


@cache
def spellings(lang: str) -> dict[str, Symbol]:
    """Symbol by spelling; of symbols with one spelling the first listed is meant."""
    out: dict[str, Symbol] = {}
    for s in symbols(lang):
        for alias in s.aliases:
            out.setdefault(alias, s)
    return out


@cache
def single_codes(lang: str) -> dict[str, str]:
    """Class by native character, of symbols that are one character: what syllables are made of."""
    return {c: kind for c, (kind, _) in native_codes(lang).items() if len(c) == 1}


def code_class(lang: str, kind: str) -> str:
    """A regular expression for native characters of a class; nothing matches where there are none."""
    found = "".join(sorted(c for c, k in single_codes(lang).items() if k == kind))
    return f"[{found}]" if found else "(?:[^\\s\\S])"
