"""Jobs over word-frequency tables: syllable bigrams, next-syllable tables, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scheme
from ..sources.scratch import cut, spread

START = "^"
# Consonants that have a grid of their own beside their first letter's.
EXTENDED = ("q", "J", "x", "GY", "R")


def word_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``word, n``: lower-case runs of Latin letters; counted in each task before the shuffle."""
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z]+"), F.lit(0))
    return settled(spread(texts.select(column)).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")))


def settled(counts: DataFrame) -> DataFrame:
    """(word, n) rows of an aggregate whose word hangs on its count: what is made of the word, and what a join or a filter asks of
    that, is evaluated once for each word. Else the planner drops the count where only distinct words are used, or moves such tests below it."""
    return counts.select(F.when(F.col("n") > 0, F.col("word")).alias("word"), "n")


def counted_where(condition: Column, n: str = "n") -> Column:
    """``condition``, for rows of a positive count: it cannot be moved below the aggregate that counts, where it would be evaluated for each occurrence."""
    return F.when(F.col(n) > 0, condition).otherwise(False)


def native_lexicon(words: DataFrame, lang: str) -> DataFrame:
    """(word, n) in native script, summed by form; a word without a form is left out."""
    form = scheme.scheme_to_script(F.col("word"), lang)
    return settled(words.groupBy(form.alias("word")).agg(F.sum("n").alias("n")).where(counted_where(F.col("word") != "")))


def akshara_bigrams(lexicon: DataFrame, lang: str) -> DataFrame:
    """``key, prev, akshara, simple, n``: how often a syllable follows another (``^``: begins a word); key is its first letter."""
    follows = lambda a: F.transform(a, lambda x, i: F.struct(F.when(i == 0, START).otherwise(F.try_element_at(a, F.greatest(i, F.lit(1)))).alias("prev"), x.alias("akshara")))
    # the count keeps the planner from testing this below the aggregate that made the words
    own = F.when(F.col("n") > 0, scheme.aksharas(F.col("word"), lang))
    pairs = lexicon.select(F.explode(scheme.let(own, follows)).alias("p"), "n")
    counted = pairs.groupBy(F.col("p.prev").alias("prev"), F.col("p.akshara").alias("akshara")).agg(F.sum("n").alias("n"))
    return counted.select(F.substring("akshara", 1, 1).alias("key"), "prev", "akshara", scheme.is_simple(F.col("akshara"), lang).alias("simple"), "n")


def top_next(bigrams: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent syllables after each (key, prev); ties go by the syllable."""
    order = Window.partitionBy("key", "prev").orderBy(F.desc("n"), "akshara")
    return bigrams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def log_normalize(top: DataFrame) -> DataFrame:
    """Add ``score``, 0 to 10: the logarithm of the count beside the largest of its (key, prev)."""
    most = F.max(F.log10("n")).over(Window.partitionBy("key", "prev"))
    return top.withColumn("score", F.round(10 * F.log10("n") / F.greatest(F.lit(0.1), most)))


def grid_cells(lang: str) -> list[tuple[str, int, str, bool]]:
    """(key, place, akshara, extended) of the fixed grid of simple syllables.

    A consonant stands with every sign (the inherent vowel's is empty), every dot and the halanth; any
    other letter alone and with every dot. Extended consonants, of several code points, have a grid too.
    """
    native, symbols = R.native_codes(lang), R.symbols(lang)
    signs = [s.code for s in symbols if s.kind == R.VOWEL]
    dots = [s.code for s in symbols if s.kind == R.DOT]
    out = []
    for code, (kind, symbol) in native.items():
        extended = symbol.aliases[0] in EXTENDED
        if kind == R.CONS and (len(code) == 1 or extended):
            out += [(code, k, code + t, extended) for k, t in enumerate([*signs, *dots, R.halanth(lang)])]
        elif kind in (R.VOWEL, R.DIGIT) and len(code) == 1:
            out += [(code, k, code + t, False) for k, t in enumerate(["", *dots])]
    return out


def simple_grid(scored: DataFrame, lang: str) -> DataFrame:
    """``key, place, akshara, score``: the grid of every key letter that occurs, 0 where a syllable isn't among the top; extended letters' grids are all 0.

    Scores are those after one previous syllable: of those that the key follows, the greatest by code point.
    """
    cells = F.broadcast(scored.sparkSession.createDataFrame(grid_cells(lang), "key string, place int, akshara string, extended boolean"))  # a rule table
    last = scored.groupBy("key").agg(F.max("prev").alias("prev"))
    of = scored.where("simple").join(last, ["key", "prev"]).select("key", "akshara", "score")
    grid = cells.where("NOT extended").join(last.select("key"), "key").join(of, ["key", "akshara"], "left")
    return grid.select("key", "place", "akshara", F.coalesce("score", F.lit(0.0)).alias("score")).unionByName(cells.where("extended").select("key", "place", "akshara", F.lit(0.0).alias("score")))


def next_table(lexicon: DataFrame, lang: str, k: int = 15) -> DataFrame:
    """``prev, key, entries``: compound syllables by (previous syllable, key letter), in their order, and at prev ``#`` each key's grid of simple ones, in the grid's order."""
    # at most k rows for each pair of syllables, read by three branches below
    scored = cut(log_normalize(top_next(akshara_bigrams(lexicon, lang), k)))
    entry = F.struct("akshara", "score")
    compound = scored.where("NOT simple").groupBy("prev", "key").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    placed = F.sort_array(F.collect_list(F.struct("place", "akshara", "score")))
    grid = simple_grid(scored, lang).groupBy("key").agg(F.transform(placed, lambda x: F.struct(x["akshara"].alias("akshara"), x["score"].alias("score"))).alias("entries"))
    return compound.unionByName(grid.select(F.lit("#").alias("prev"), "key", "entries"))


def rollup_by_form(words: DataFrame, form: Column) -> DataFrame:
    """``form, freq, sources``: frequencies and sorted source words by transliterated form; no form, no row."""
    formed = words.groupBy(form.alias("form")).agg(F.sum("n").alias("freq"), F.sort_array(F.collect_list("word")).alias("sources"))
    return formed.where(counted_where(F.col("form") != "", "freq"))


def merge_lexicons(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("word").unionByName(b.select("word")).distinct()


def dedupe_examples(examples: DataFrame) -> DataFrame:
    """Examples of one word with the same letter, window and offset count once, the first of them; across words all count."""
    order = Window.partitionBy("word_id", "key", "window", "offset").orderBy("pos", "cls")
    first = examples.withColumn("__k", F.row_number().over(order)).where("__k = 1")
    return first.groupBy("key", "window", "offset", "cls").agg(F.count("*").alias("n"))
