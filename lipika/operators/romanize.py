"""Native words to aligned Latin spellings and training examples, and sounds to native words.

The rules of a letter are (pattern, typed forms) in order. Of all rules whose group 1 begins at the
letter the strictly longest match wins, the first of equals; matches are those of a non-overlapping
scan, so a rule whose left context an earlier match has used does not fire. That is beyond column
expressions, so a small helper does it, once for each distinct word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters, phonemes, scheme, text
from . import trees

EPSILON = letters.EPSILON
#: Spellings of one word that one call of ``romanizations`` lists; ``training_examples`` needs no such limit.
CAP = 10_000
#: Spellings of a word up to which its examples are read off all of them.
FEW = 24
#: Phones, over all its spellings, that a row of a pronunciation's candidates has; longer lists are several rows.
BLOCK = 1 << 20


@cache
def _rules(lang: str) -> dict[str, list[tuple[re.Pattern, tuple[str, ...]]]]:
    return {letter: [(re.compile(p), o) for p, o in rules] for letter, rules in letters.producers(lang).items()}


def options_of(word: str, lang: str) -> list[tuple[str, ...]] | None:
    """Each letter's typed forms; None for a word with a letter that no rule knows or fits, or that begins with a letter that may be blank."""
    rules, chain = _rules(lang), []
    found: dict[str, dict[int, tuple[int, tuple[str, ...]]]] = {}
    for place, letter in enumerate(word):
        if letter not in rules:
            return None
        if letter not in found:  # all places of the letter at once
            best = found[letter] = {}
            for pattern, options in rules[letter]:
                for m in pattern.finditer(word):
                    if len(m.group()) > best.get(m.start(1), (0, ()))[0]:
                        best[m.start(1)] = len(m.group()), options
        if place not in found[letter]:
            return None
        chain.append(found[letter][place][1])
    return None if chain and not all(o.strip() for o in chain[0]) else chain


def number_of_spellings(chain: list[tuple[str, ...]] | None) -> int:
    """How many spellings a word with these options has; 0 without."""
    return prod(map(len, chain)) if chain else 0


def spelling_at(word: str, chain: list[tuple[str, ...]], rank: int) -> tuple[list[str], list[str]]:
    """The word's spelling of that rank as (letters, classes) of equal length; the last letter varies slowest.

    A blank option adds its native letter to the class before; an option of several letters gives
    its class to the first and ``EPSILON`` to the others.
    """
    typed: list[str] = []
    classes: list[str] = []
    at = 0
    for options, native in zip(chain, word, strict=True):
        rank, k = divmod(rank, len(options))
        if not options[k].strip():
            classes[at] += native
        else:
            at = len(classes)
            typed += options[k]
            classes += [native] + [EPSILON] * (len(options[k]) - 1)
    return typed, classes


def _all_spellings(word: str, chain: list[tuple[str, ...]]) -> Iterator[tuple[str, list[str]]] | None:
    """All spellings in order as (letters in one string, classes), each made from its letters' parts; None where a letter is blank in some of them only."""
    own: list[tuple[str, tuple[str, ...]]] = []
    for options, native in zip(chain, word, strict=True):
        blank = [not o.strip() for o in options]
        if own and len(options) == 1 and blank[0]:
            own[-1] = own[-1][0] + native, own[-1][1]
        elif any(blank):
            return None
        else:
            own.append((native, options))
    parts = [[(o, [native] + [EPSILON] * (len(o) - 1)) for o in options] for native, options in reversed(own)]  # the last letter varies slowest
    return (("".join([o for o, _ in reversed(one)]), [c for _, classes in reversed(one) for c in classes]) for one in product(*parts))


def _spellings(word: str, chain: list[tuple[str, ...]] | None, cap: int, start: int) -> Iterator[tuple[str, list[str]]]:
    """At most ``cap`` spellings from rank ``start`` on, letters in one string."""
    many = number_of_spellings(chain)
    whole = _all_spellings(word, chain) if chain and start == 0 and many <= cap else None
    return whole if whole is not None else (("".join(a), b) for a, b in (spelling_at(word, chain, k) for k in range(start, min(start + cap, many))))


def aligned(word: str, lang: str, cap: int = CAP, start: int = 0) -> list[tuple[list[str], list[str]]]:
    """At most ``cap`` spellings from rank ``start`` on. Unknown letters, letters that no rule fits and a blank at the start give none."""
    return [(list(a), b) for a, b in _spellings(word, options_of(word, lang), cap, start)]


def romanizations(words: DataFrame, lang: str, cap: int = CAP, only: str | None = None, start: int = 0) -> DataFrame:
    """``word, rank, letters, classes, flags, truncated`` of distinct native words, a row for each spelling of rank ``start`` to ``start`` + ``cap`` - 1.

    Words without a spelling give no row. The number of spellings grows with the power of a word's length, so a
    call gives a range of ranks; ``truncated`` says that there are ranks beyond it, which another ``start`` gives. ``flags``
    tells which letters are among ``only`` (all, where it is not given).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(words: list[str], ranks: list[int], typed: list[str], classes: list[str], more: list[bool]) -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, typed)]), pa.int32())
            letters = list("".join(typed))
            flags = np.ones(len(letters), bool) if only is None else [c in only for c in letters]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, of)) for x, of in ((letters, pa.string()), (classes, pa.string()), (flags, pa.bool_()))]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ranks, pa.int64()), *lists, pa.array(more, pa.bool_())], ["word", "rank", "letters", "classes", "flags", "truncated"])

        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            words, ranks, typed, classes, more = columns
            for word in batch.column("word").to_pylist():
                chain, before = options_of(word, lang), len(typed)
                for letters, own in _spellings(word, chain, cap, start):
                    typed.append(letters)
                    classes += own
                made = len(typed) - before
                words += [word] * made
                ranks += range(start, start + made)
                more += [number_of_spellings(chain) > start + cap] * made
                if len(typed) >= CAP:  # words may have many spellings
                    yield packed(*columns)
                    for column in columns:
                        column.clear()
            yield packed(*columns)

    distinct = words.select("word").where("word IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "word string, rank long, letters array<string>, classes array<string>, flags array<boolean>, truncated boolean")


def spelled_as(native: str, literal: str, lang: str) -> tuple[list[str], list[str]] | None:
    """The first spelling of a native word that is the literal, as (letters, classes), however many spellings it has; None if there is none."""
    chain = options_of(native, lang)
    if not chain:
        return None
    # which rests of the literal the letters from k on can spell
    ends = [set() for _ in chain] + [{len(literal)}]
    for k in range(len(chain) - 1, -1, -1):
        for option in chain[k]:
            ends[k] |= {e - len(option) for e in ends[k + 1] if e >= len(option) and literal[e - len(option) : e] == option}
    if 0 not in ends[0]:
        return None
    # the last letter varies slowest: of the spellings that fit, the first has the least option of the last letter, then of the one before
    starts = [{0}] + [set() for _ in chain]
    for k, options in enumerate(chain):
        for s in starts[k]:
            starts[k + 1] |= {s + len(o) for o in options if literal.startswith(o, s)}
    at, picked = len(literal), []
    for k in range(len(chain) - 1, -1, -1):
        option = next(o for o in chain[k] if at - len(o) in starts[k] and literal[at - len(o) : at] == o)
        picked.append(option)
        at -= len(option)
    typed, classes, last = [], [], 0
    for option, own in zip(reversed(picked), native, strict=True):
        if not option:
            classes[last] += own
        else:
            last = len(classes)
            typed += option
            classes += [own] + [EPSILON] * (len(option) - 1)
    return typed, classes


def align_pair(pairs: DataFrame, lang: str) -> DataFrame:
    """Distinct (literal, word) pairs with ``letters, classes, exact``: the word's spelling that is the literal, else letter by letter, padded. Nulls give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            literals, words = batch.column("literal").to_pylist(), batch.column("word").to_pylist()
            found = []
            for literal, word in zip(literals, words, strict=True):
                n = max(len(literal), len(word))
                pad = lambda x: [*x, *[EPSILON] * (n - len(x))]  # noqa: B023, E731
                fit = spelled_as(word, literal.strip(), lang)
                found.append((*fit, True) if fit else (pad(literal), pad(word), False))
            arrays = [pa.array(c, pa.list_(pa.string())) for c in ([f[0] for f in found], [f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([pa.array(literals, pa.string()), pa.array(words, pa.string()), *arrays, pa.array([f[2] for f in found], pa.bool_())], ["literal", "word", "letters", "classes", "exact"])

    distinct = pairs.select("literal", "word").where("literal IS NOT NULL AND word IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "literal string, word string, letters array<string>, classes array<string>, exact boolean")


def _told(word: str, lang: str, scope: int, ahead: int) -> list[str]:
    """The examples of ``examples_of``, each as its letter, a character for its place in the window (from 1), the window, a tab and its class.

    A word of ``FEW`` spellings has them listed. Of others, what can stand before and after a letter is built letter by letter, no more of it than tells examples apart
    (``scope`` characters), with the number of the first spelling that has it: spellings are numbered with the last letter
    varying slowest, so an option adds its index times the number of spellings of the letters before it. What
    follows beyond ``scope``, and the native letters that are typed blank right there, are those of that spelling.
    Of examples with the same letter within ``scope`` the first spelling's is kept.
    """
    chain = options_of(word, lang)
    if not chain:
        return []
    if (many := number_of_spellings(chain)) <= FEW:
        first: dict[str, str] = {}
        for typed, classes in _spellings(word, chain, many, 0):
            marked = f"#{typed}_"
            for at, (letter, cls) in enumerate(zip(typed, classes, strict=True), 1):
                start = at - scope if at > scope else 0
                place = chr(at - start + 1)
                identity = place + marked[start : at + scope + 1]
                if identity not in first:
                    first[identity] = f"{letter}{place}{marked[start : at + ahead + 1]}\t{cls}"
        return list(first.values())
    stride = [1]
    for options in chain:
        stride.append(stride[-1] * len(options))
    before: list[dict[str, int]] = [{"#": 0}]
    for options, step in zip(chain, stride[:-1], strict=True):
        now: dict[str, int] = {}
        if options == ("",):
            now = before[-1]
        else:
            for left, n in before[-1].items():
                for o in options:
                    key = (left + o)[-scope:]
                    if key not in now or n < now[key]:
                        now[key] = n
                    n += step
        before.append(now)
    best: dict[str, tuple[int, str]] = {}
    # by what follows: (number, that and more of it, the blank letters)
    after: dict[str, tuple[int, str, str]] = {"_": (0, "_", "")}
    for k in range(len(chain) - 1, -1, -1):
        rests: dict[str, dict[str, tuple[int, str, str]]] = {"": after}  # the same behind the rest of an option
        now: dict[str, tuple[int, str, str]] = {}
        number = 0
        for o in chain[k]:
            for j in reversed(range(len(o))):
                rest = o[j + 1 :]
                if rest not in rests:
                    rests[rest] = _behind(rest, after, scope, ahead)
                own = [(right, m + number, f"{more}\t{word[k] + blank if j == 0 else EPSILON}") for right, (m, more, blank) in rests[rest].items()]
                for left, n in before[k].items():
                    lead = (left + o[:j])[-scope:]
                    lead = f"{o[j]}{chr(len(lead) + 1)}{lead}{o[j]}"
                    for right, m, told in own:
                        identity = lead + right
                        # letters are taken from the last to the first, and of one spelling's the first is kept
                        if identity not in best or n + m <= best[identity][0]:
                            best[identity] = n + m, lead + told
            for right, (m, more, blank) in (_behind(o, after, scope, ahead) if o else after).items():
                if right not in now or m + number < now[right][0]:
                    now[right] = m + number, more, "" if o else word[k] + blank
            number += stride[k]
        after = now
    return [told for _, told in best.values()]


def _behind(typed: str, after: dict[str, tuple[int, str, str]], scope: int, ahead: int) -> dict[str, tuple[int, str, str]]:
    """What follows a letter, where ``typed`` stands before it."""
    out: dict[str, tuple[int, str, str]] = {}
    for right, found in after.items():
        key = (typed + right)[:scope]
        if key not in out or found[0] < out[key][0]:
            out[key] = found[0], (typed + found[1])[:ahead], found[2]
    return out


def examples_of(word: str, lang: str, scope: int, ahead: int) -> list[tuple[str, str, int, str]]:
    """(key, window, offset, class) of all spellings of a word, equal ones once, without listing the spellings; ``ahead`` is ``scope`` at least."""
    cut = [(told[0], ord(told[1]) - 1, *told[2:].split("\t")) for told in _told(word, lang, scope, ahead)]
    return [(key, window, offset, cls) for key, offset, window, cls in cut]


def training_examples(words: DataFrame, lang: str, scope: int = trees.SCOPE) -> DataFrame:
    """``key, window, offset, cls, n``: what the trees learn from, from every distinct word that has a spelling.

    Equal examples of one word count once, the first of them; across words all count. Windows are
    marked (``#`` before a word, ``_`` after it) and reach ahead as far as a feature can.
    """
    ahead = trees.reach(scope, letters.feature_groups(lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a string for each example: one column is cheaper to count by than four
            told = [x for word in batch.column("word").to_pylist() for x in _told(word, lang, scope, ahead)]
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.string())], ["told"])

    distinct = words.select("word").where("word IS NOT NULL").distinct()
    counted = distinct.mapInArrow(run, "told string").groupBy("told").agg(F.count("*").alias("n"))
    offset = F.ascii(F.substr("told", F.lit(2), F.lit(1))) - 1
    window, cls = (F.substring_index(F.substr("told", F.lit(3)), "\t", k) for k in (1, -1))
    return counted.select(F.substr("told", F.lit(1), F.lit(1)).alias("key"), window.alias("window"), offset.alias("offset"), cls.alias("cls"), "n")


# --- sounds -------------------------------------------------------------------------------------


def phoneme_options(words: DataFrame, lang: str) -> DataFrame:
    """Distinct (phones) rows with ``chain``: each phoneme's scheme spellings in its context in a language; an unknown phoneme leaves none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phones = batch.column("phones").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("phones"), pa.array([phonemes.options(p, lang) for p in phones], pa.list_(pa.list_(pa.string())))], ["phones", "chain"])

    return words.select("phones").where("phones IS NOT NULL").distinct().mapInArrow(run, "phones array<string>, chain array<array<string>>")


def join_phones(phones: Column) -> Column:
    """Phones of a word's letters in one string: blank and silent (``#``) ones fall away; a dash at the beginning or else the end of one stands alone, once."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("dash"))

    def with_part(acc, part, present):
        return F.struct(F.when(present, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"), F.when(present, False).otherwise(acc["dash"]).alias("dash"))

    def with_dash(acc):
        return F.struct(F.when(acc["dash"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.lit("-")))).alias("parts"), F.lit(True).alias("dash"))

    def step(acc, raw):
        p = F.replace(raw, F.lit("_"), F.lit(" "))
        rest, head = F.substr(p, F.lit(2)), F.substr(p, F.lit(1), F.char_length(p) - 1)
        begins, ends = p.startswith("-"), p.endswith("-")
        return F.when(F.trim(p) == "", acc).when(begins, with_part(with_dash(acc), rest, rest != "#")).when(ends, with_dash(with_part(acc, head, head != "#"))).otherwise(with_part(acc, p, p != "#"))

    return F.array_join(F.aggregate(phones, start, step, lambda acc: acc["parts"]), " ")


def _phone_lists(words: DataFrame) -> DataFrame:
    """(word, phones: array of a word's phones by letter) with its phones one by one."""
    clean = text.strip_stress(text.clean_pronunciation(join_phones(F.col("phones"))))
    return words.select("word", F.filter(F.split(clean, " "), lambda p: p != "").alias("phones"))


def _sound_chains(staged: DataFrame, lang: str, block: int, several: bool | None = None, first: bool = False) -> DataFrame:
    """``word, rank, chain``: each phone's spellings, in rows of so many joins as have ``block`` phones (one at least); ``rank`` is the number of joins before.

    The last phones, which vary slowest, have one spelling each in a row of a word that needs several rows. ``several`` asks for
    only the words that do or do not; ``first`` leaves each phone its first spelling.
    """

    def rows_of(word: str, chain: list[list[str]]) -> Iterator[tuple[str, int, list[list[str]]]]:
        many, fit = number_of_spellings(chain) if chain else 1, max(block // max(len(chain), 1), 1)
        if several is not None and several != (many > fit):
            return
        if many <= fit:
            yield word, 0, chain if many else [[]]
            return
        head, size = 0, 1
        while size * len(chain[head]) <= fit:
            size *= len(chain[head])
            head += 1
        for k, tail in enumerate(product(*reversed(chain[head:]))):
            yield word, k * size, chain[:head] + [[o] for o in reversed(tail)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple[str, int, list[list[str]]]]) -> pa.RecordBatch:
            words, ranks, chains = ([r[k] for r in rows] for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ranks, pa.int64()), pa.array(chains, pa.list_(pa.list_(pa.string())))], ["word", "rank", "chain"])

        for batch in batches:
            rows: list[tuple[str, int, list[list[str]]]] = []
            held = 0
            for word, phones in zip(batch.column("word").to_pylist(), batch.column("phones").to_pylist(), strict=True):
                if phones is None:
                    continue
                chain = phonemes.options(phones, lang)
                for row in rows_of(word, [o[:1] for o in chain] if first else chain):
                    rows.append(row)
                    held += len(row[2])
                    if held >= BLOCK:  # words may need many rows
                        yield packed(rows)
                        rows, held = [], 0
            yield packed(rows)

    return staged.mapInArrow(run, "word string, rank long, chain array<array<string>>")


def _sounded(chains: DataFrame, lang: str, *more: Column) -> DataFrame:
    joined = chains.select("word", "rank", text.expand_options(F.col("chain"), None).alias("s"), *more)
    return joined.withColumn("options", F.array_distinct(F.transform("s", lambda s: scheme.scheme_to_script(s, lang)))).drop("s")


def sound_candidates(words: DataFrame, lang: str, block: int = BLOCK) -> DataFrame:
    """(word, phones: array of a word's phones by letter) with ``options, rank``: native words as the pronunciation sounds, all of them.

    Their number grows with the power of a word's length, so a pronunciation whose spellings have more than ``block`` phones gives several rows, each with the
    rank of its first spelling; equal candidates are in a row once. ``distinct_sounds`` has them once in all rows of a word.
    """
    # almost every word has phones of its own, so they're not made distinct and joined
    return _sounded(_sound_chains(_phone_lists(words), lang, block), lang)


def first_sounds(words: DataFrame, lang: str) -> DataFrame:
    """(word, phones: array of a word's phones by letter) with ``options``: only the first of its ``sound_candidates``, without making the others."""
    return _sounded(_sound_chains(_phone_lists(words), lang, BLOCK, first=True), lang).drop("rank")


def distinct_sounds(words: DataFrame, lang: str, block: int = BLOCK) -> DataFrame:
    """``sound_candidates`` of distinct words, equal candidates of a word once, the first of them; ``rank`` orders a word's rows.

    Words of several rows are few and may be long, so their rows are dealt out over all tasks before they are joined, and a shuffle drops what is equal.
    """
    few = _sounded(_sound_chains(_phone_lists(words), lang, block, several=False), lang)
    # as written, a word has no fewer phones of several spellings than its pronunciation, and no fewer characters than that has phones
    choices = {p: max(len(own) for _, own in rules) for p, rules in phonemes.rules(lang).items()}
    written = F.translate(F.array_join("phones", " "), "#$012", "")
    choosing = F.regexp_count(written, F.lit("|".join(re.escape(p) for p, n in choices.items() if n > 1)))
    long = words.where(F.pow(F.lit(float(max(choices.values()))), choosing) * F.char_length(written) > block)
    chains = _sound_chains(_phone_lists(long), lang, block, several=True)
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = F.greatest(F.lit(block) / F.size("chain"), F.lit(1)).cast("long").alias("fit")
    # no row is empty; the other posexplode tests for that before the rows are dealt out, by joining them all there
    each = _sounded(chains.repartition(tasks, "word", "rank"), lang, fit).select("word", "rank", "fit", F.posexplode_outer("options").alias("k", "option"))
    once = each.groupBy("word", "option").agg(F.min(F.col("rank") + F.col("k")).alias("rank"), F.min("fit").alias("fit"))
    rows = once.groupBy("word", F.expr("rank DIV fit").alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "option"))).alias("o"))
    return few.unionByName(rows.select("word", F.col("o")[0]["rank"].alias("rank"), F.transform("o", lambda x: x["option"]).alias("options")))


def follow_focus(word: str, focus: int, rewrites: list[tuple[str, str]]) -> tuple[str, int]:
    """The rewritten word and where its letter ``focus`` has gone; a letter inside a rewrite stays inside what replaces it."""
    word = word.lower()
    for pattern, instead in rewrites:
        done, at, moved = [], 0, focus
        for m in re.finditer(pattern, word):
            new = m.expand(instead)
            if m.end() <= focus:
                moved += len(new) - len(m.group())
            elif m.start() <= focus:
                start = sum(map(len, done)) + m.start() - at
                moved = start + min(focus - m.start(), max(len(new) - 1, 0))
            done += [word[at : m.start()], new]
            at = m.end()
        word, focus = "".join([*done, word[at:]]), moved
    return word, focus


def preprocess_with_focus(rows: DataFrame, lang: str = "hindi") -> DataFrame:
    """Distinct (word, focus) with ``typed, at``: the rewritten word and the letter's place in it, step by step."""
    rules = letters.REWRITES[lang]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, places = batch.column("word").to_pylist(), batch.column("focus").to_pylist()
            found = [follow_focus(w, p, rules) for w, p in zip(words, places, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], ["word", "focus", "typed", "at"])

    distinct = rows.select("word", F.col("focus").cast("long").alias("focus")).where("word IS NOT NULL AND focus IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "word string, focus long, typed string, at long")
