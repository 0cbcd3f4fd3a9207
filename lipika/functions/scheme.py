"""Scheme spelling to native script and back, and syllables, as column expressions without Python per row."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters
from . import rules as R


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lookup(entries: dict[str, str], key: Column) -> Column:
    """A constant table's value for a key, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in entries.items() for x in pair]), key)


def tokenize(literal: Column, lang: str) -> Column:
    """Longest spellings first; a character of no spelling is a token of its own."""
    return F.regexp_extract_all(literal, F.lit(f"(?:{R.any_of(R.spellings(lang))})|(?s:.)"), F.lit(0))


#: First of the code points that stand for tokens while a spelling is converted; such characters in a spelling itself are dropped.
_CODES = 0xF0000


@cache
def _coded(lang: str, running: bool) -> tuple[list[tuple[str, R.Symbol, str]], str, str]:
    """Each spelling with its symbol and the character that stands for it (a symbol's spellings share one), and two marks.

    In running text, lower-cased, only spellings of small letters count: a symbol is then its own
    small letter or one of the capitals, which the text has none of.
    """
    meant = R.spellings(lang)
    use = [(s, [a for a in s.aliases if meant[a] is s and (not running or re.fullmatch("[a-z]+|OM", a))]) for s in sorted(R.symbols(lang), key=lambda s: (s.kind, s.order))]
    free = iter("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if running else [chr(_CODES + k) for k in range(256)])
    end, sign = next(free), next(free)
    out = []
    for s, aliases in use:
        if aliases:
            own = [a for a in aliases if running and len(a) == 1]
            code = own[0] if own else next(free)
            out += [(a, s, code) for a in aliases]
    return out, end, sign


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Single characters by one look-up table, longer strings one after another, the longest first."""
    for old, new in sorted((p for p in pairs if len(p[0]) > 1 or len(p[1]) > 1), key=lambda p: -len(p[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    single = [p for p in pairs if len(p[0]) == 1 and len(p[1]) <= 1]
    single.sort(key=lambda p: p[1] == "")  # those that vanish stand last, beyond the end of what replaces
    return F.translate(text, "".join(p[0] for p in single), "".join(p[1] for p in single)) if single else text


def _encoded(text: Column, lang: str, running: bool) -> Column:
    """Tokens as single characters, the longest spelling first."""
    coded, end, _ = _coded(lang, running)
    long = [alias for alias, _, _ in coded if len(alias) > 1]
    # marked, a token of several characters can't be taken for the end of another
    text = F.regexp_replace(text, f"(?:{R.any_of(long)})", f"$0{end}")
    return _replaced(text, [(alias + end if len(alias) > 1 else alias, code) for alias, _, code in coded if alias != code])


def _rendered(text: Column, lang: str, running: bool) -> Column:
    """Native text of coded tokens.

    A vowel right after a consonant is a sign, elsewhere a letter; neighbouring consonants get a
    halanth between them; a joiner brings a halanth if there is none; a delimiter after a vowel
    falls away; in some languages a consonant that ends a word gets a halanth.
    """
    coded, _, sign = _coded(lang, running)
    table = {code: s for _, s, code in coded}
    of = {k: "".join(c for c, s in table.items() if s.kind == k) for k in (R.CONS, R.VOWEL, R.NUKTA, R.JOINER, R.HALANTH, R.DELIM)}
    # where codes are not letters, a class is a range
    some = lambda k: (f"[{of[k]}]" if running else f"[{min(of[k])}-{max(of[k])}]") if of[k] else None
    cons, vowel, nukta, virama = some(R.CONS), some(R.VOWEL), some(R.NUKTA), R.halanth(lang)
    closed = f"({cons}{nukta}?)" if nukta else f"({cons})"
    if R.LANGUAGES[lang].final_halanth:
        every = f"[{''.join(table)}]" if running else f"[{min(table)}-{max(table)}]"
        text = F.regexp_replace(text, f"{closed}(?!{every})", f"$1{virama}")
    text = F.regexp_replace(text, f"{closed}(?={cons})", f"$1{virama}")
    text = F.regexp_replace(text, f"{closed}(?={vowel})", f"$1{sign}")
    if of[R.DELIM]:
        text = F.regexp_replace(text, f"(?<={vowel}){some(R.DELIM)}", "")
    if nukta:
        text = F.regexp_replace(text, f"(?<!{cons}){nukta}", "")
    if of[R.JOINER]:
        text = F.regexp_replace(text, f"(?<!{some(R.HALANTH)})(?={some(R.JOINER)})", virama)
    signs = [(sign + c, s.code) for c, s in table.items() if s.kind == R.VOWEL]
    return _replaced(text, signs + [(c, s.letter if s.kind == R.VOWEL else s.code) for c, s in table.items()])


def scheme_to_script(literal: Column, lang: str) -> Column:
    """A scheme spelling in native script; null stays null.

    Tokens become single characters, longest spelling first; contexts are regular expressions over
    classes of these; then they become native text. All of it is generated code, with no look-up
    by token.
    """
    if R.LANGUAGES[lang].oum:
        literal = F.regexp_replace(literal, "^(oum)$", "OM")
    literal = F.regexp_replace(literal, f"[{chr(_CODES)}-{chr(_CODES + 255)}]", "")
    return _rendered(_encoded(literal, lang, False), lang, False)


def words_to_script(text: Column, lang: str) -> Column:
    """A text whose Latin words, lower-cased, are scheme spellings: these in native script, all else as it is, in one pass."""
    text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    if R.LANGUAGES[lang].oum:
        om = next(code for alias, _, code in _coded(lang, True)[0] if alias == "OM")
        text = F.regexp_replace(text, "(?<![a-z])oum(?![a-z])", om)
    return _rendered(_encoded(text, lang, True), lang, True)


def script_to_symbols(word: Column, lang: str) -> Column:
    """Native codes, longest first; other characters one by one."""
    return F.regexp_extract_all(word, F.lit(f"(?:{R.any_of(R.native_codes(lang))})|(?s:.)"), F.lit(0))


def script_to_scheme(word: Column, lang: str) -> Column:
    """All spellings of a native word: the k-th takes each symbol's k-th alias, or its last.

    The inherent ``a`` goes between a consonant and a consonant, dot or vowel, and after a lone
    consonant; ``/`` goes between a vowel and a vowel. Where a consonant that ends a word is written
    with a halanth, the spelling drops that halanth, and a consonant without one gets the ``a``.
    """
    return let(script_to_symbols(word, lang), lambda codes: _spellings(codes, lang))


def _spellings(codes: Column, lang: str) -> Column:
    native = R.native_codes(lang)
    kinds = {c: k for c, (k, _) in native.items()}
    names = {c: "\u0001".join(s.aliases) for c, (_, s) in native.items()}
    final = R.LANGUAGES[lang].final_halanth
    most = F.array_max(F.transform(codes, lambda c: F.size(F.split(F.coalesce(_lookup(names, c), c), "\u0001"))))

    def spelled(k: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            kind = lambda step: F.coalesce(F.when(i + step >= 0, _lookup(kinds, F.try_element_at(codes, F.greatest(i + step + 1, F.lit(1))))), F.lit(""))
            own, prior, before, following = F.coalesce(kind(0), F.lit(R.OTHER)), kind(-1), kind(-2), kind(1)
            aliases = F.split(F.coalesce(_lookup(names, c), c), "\u0001")
            alias = F.element_at(aliases, F.least(k, F.size(aliases)))
            silent = (own == R.HALANTH) & ((following == R.CONS) | ((following == "") if final else F.lit(False)))
            alone = (following == "") if final else (prior == "") & (following == "")
            inherent = (own == R.CONS) & (following.isin(R.CONS, R.DOT, R.VOWEL) | alone)
            hiatus = (own == R.VOWEL) & (prior.isin(R.VOWEL, R.SIGN, R.CONS) | ((prior == R.NUKTA) & (before == R.CONS)))
            return F.concat(F.when(hiatus, "/").otherwise(""), F.when(silent, "").otherwise(alias), F.when(inherent, "a").otherwise(""))

        return F.array_join(F.transform(codes, one), "")

    return F.when(F.size(codes) == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), most), spelled))


def round_trip(spelling: Column, word: Column, lang: str) -> Column:
    """A spelling without its ``/`` marks if with them it renders to the word, else as it is."""
    return F.when(scheme_to_script(spelling, lang) == word, F.replace(spelling, F.lit("/"), F.lit(""))).otherwise(spelling)


def syllable_pattern(lang: str) -> str:
    of = R.LANGUAGES[lang]
    cons, nukta, virama, sign, dot, vowel, digit = (R.code_class(lang, k) for k in (R.CONS, R.NUKTA, R.HALANTH, R.SIGN, R.DOT, R.VOWEL, R.DIGIT))
    joiner = R.JOINERS + "?"
    cluster = f"{cons}{nukta}?(?:{virama}{joiner}{cons}{nukta}?){{0,3}}"
    close = f"{virama}{joiner}$"
    tail = f"(?:{sign}{dot}?|{close})?" if of.dot_needs_sign else f"(?:{close}|{sign}?{dot}?)?"
    return f"{vowel}{dot}?|{cluster}{tail}|{digit}"


def simple_pattern(lang: str) -> str:
    cons, nukta, virama, sign, dot, vowel = (R.code_class(lang, k) for k in (R.CONS, R.NUKTA, R.HALANTH, R.SIGN, R.DOT, R.VOWEL))
    return f"^(?:{vowel}{dot}?|{cons}{nukta}?(?:{dot}|{sign}|{virama}{R.JOINERS}?)?)$"


def aksharas(word: Column, lang: str) -> Column:
    """A native word's syllables in order; characters outside the script are dropped first."""
    known = "".join(sorted(R.single_codes(lang)))
    kept = F.regexp_replace(word, f"[^{re.escape(known)}]", "")
    return F.regexp_extract_all(kept, F.lit(f"(?:{syllable_pattern(lang)})"), F.lit(0))


def is_simple(akshara: Column, lang: str) -> Column:
    return akshara.rlike(simple_pattern(lang))


def is_valid_word(word: Column, lang: str) -> Column:
    """Whether the word pattern, read from the start, takes the whole word."""
    return (word != "") & (F.regexp_extract(word, f"^(?:{letters.word_pattern(lang)})", 0) == word)


def valid_words(text: Column, lang: str) -> Column:
    return F.regexp_extract_all(text, F.lit(letters.word_pattern(lang)), F.lit(0))
