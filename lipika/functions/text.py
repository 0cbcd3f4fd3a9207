"""Runs, markup and small string functions, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import letters

def split_runs(text: Column) -> Column:
    """Maximal runs of Latin letters and of anything else, in order; joined again they are the text."""
    return F.regexp_extract_all(text, F.lit("[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))


def is_word_run(run: Column) -> Column:
    return run.rlike("^[a-zA-Z]")


def is_plain_latin(word: Column) -> Column:
    """None of the scheme's marks and no digit."""
    return ~word.rlike("[.~^/0-9]")


def preprocess(word: Column, lang: str = "hindi") -> Column:
    """Lower case, then the language's rewrites in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), letters.REWRITES[lang], F.lower(word))


def letter_window(word: Column, focus: Column, scope: int = 4) -> Column:
    """The letters around the one at ``focus`` (from 0) and the focus's place among them."""
    start = F.greatest(focus - scope, F.lit(0))
    return F.struct(F.substr(word, start + 1, focus + scope + 1 - start).alias("window"), (focus - start).alias("offset"))


def expand_options(chain: Column, cap: int | None = 100) -> Column:
    """All joins of one option of each letter, the last letter varying slowest; over ``cap``, if there is one, only that of the first options."""
    start = F.array(F.lit(""))
    grown = F.aggregate(chain, start, lambda done, options: F.flatten(F.transform(options, lambda o: F.transform(done, lambda d: F.concat(d, o)))))
    if cap is None:
        return grown
    size = F.aggregate(chain, F.lit(1).cast("double"), lambda n, options: n * F.size(options))
    return F.when(size > cap, F.array(F.array_join(F.transform(chain, lambda o: F.try_element_at(o, F.lit(1))), ""))).otherwise(grown)


def clean_pronunciation(pron: Column) -> Column:
    """Blanks for ``_``, no ``#`` and ``$``, ``ah r`` for ``er``, and dashes on their own."""
    out = F.translate(F.replace(pron, F.lit("_"), F.lit(" ")), "#$", "")
    phones = F.filter(F.split(F.replace(out, F.lit("-"), F.lit(" - ")), " "), lambda p: p != "")
    return F.array_join(F.transform(phones, lambda p: F.when(p == "er", "ah r").otherwise(p)), " ")


def strip_stress(pron: Column) -> Column:
    """No stress digits, but ``ow1`` for a stressed ``ow``."""
    kept = F.regexp_replace(pron, r"\bow[12]\b", "ow\u0001")
    return F.replace(F.regexp_replace(kept, r"(?<=[a-z])[0-2]", ""), F.lit("\u0001"), F.lit("1"))


def strip_epsilon(chars: Column, epsilon: str = letters.EPSILON) -> Column:
    return F.transform(chars, lambda c: F.when(c == epsilon, "").otherwise(c))


#: Markup commands; of two that begin alike the first listed is read.
MARKUP_LANGUAGES = ("english", "hindi", "marathi", "nepali", "bengali", "punjabi", "gujarati", "tamil", "telugu", "kannada", "malayalam")
MARKUP_MODES = ("itrans", "xliterate", "predictive")


def segment_markup(text: Column, lang: str = "english") -> Column:
    r"""Spans of marked text, as array of (lang, mode, text).

    ``\language`` switches the language of what follows, ``\mode{...}`` shows one span in a mode
    (not in english), and a backslash before a command makes it plain text.
    """
    languages, modes = "|".join(MARKUP_LANGUAGES), "|".join(MARKUP_MODES)
    pattern = rf"(?s)\\\\(?:{languages})|\\(?:{languages})|\\(?:{modes})\{{[^}}]*\}}|[^\\]+|\\"
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    switch = lambda p: p.rlike(rf"^\\(?:{languages})$")
    start = F.struct(F.lit(lang).alias("lang"), F.array().cast("array<struct<lang:string,mode:string,text:string>>").alias("out"))

    def step(acc, p):
        span = p.rlike(rf"^\\(?:{modes})\{{") & (acc["lang"] != "english")
        mode = F.when(span, F.regexp_extract(p, r"^\\([a-z]+)\{", 1)).otherwise("predictive")
        body = F.when(span, F.regexp_extract(p, r"(?s)\{(.*)\}$", 1)).when(p.startswith("\\\\"), F.substr(p, F.lit(2))).otherwise(p)
        one = F.array(F.struct(acc["lang"].alias("lang"), mode.alias("mode"), body.alias("text")))
        return F.struct(
            F.when(switch(p), F.substr(p, F.lit(2))).otherwise(acc["lang"]).alias("lang"),
            F.when(switch(p), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])
