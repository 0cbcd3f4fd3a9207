"""End-user jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters, scheme, text
from ..functions import rules as R
from ..operators import lexicon, lookup, predict, romanize, sounds, trees
from ..sources.scratch import cut, spread


def transliterate_text(docs: DataFrame, lang: str) -> DataFrame:
    """(doc_id, text) with every Latin word, lower-cased, in native script; all else untouched.

    The conversion is a column expression applied in place: one pass, and no shuffle but for a small table.
    """
    return spread(docs.select("doc_id", "text")).select("doc_id", scheme.words_to_script(F.coalesce("text", F.lit("")), lang).alias("text"))


def transliterate_predicted(docs: DataFrame, lang: str, **models) -> DataFrame:
    """(doc_id, text) with every Latin word as its first suggestion; all else untouched. ``models`` as in ``suggest``."""
    convert = lambda words: predict.top_suggestion(predict.suggest(words, lang, **models)).withColumnRenamed("option", "out")
    return lookup.apply_per_distinct_word(docs, convert)


def render_markup(docs: DataFrame, lang: str = "english", models: dict[str, DataFrame] | None = None) -> DataFrame:
    """(doc_id, text) with its markup applied, a row for each row: scheme spans in the script of their language, predictive
    spans with each Latin word's first prediction by that language's trees in ``models`` (as they are without), all else as it is."""
    spans = text.segment_markup(F.coalesce("text", F.lit("")), lang)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", spans.alias("spans"))
    each = numbered.select("row", "doc_id", F.posexplode_outer("spans").alias("pos", "s")).select(F.struct("row", "pos", "doc_id").alias("id"), "s.*")
    # written once, for a branch by language reads it: the conversions of all languages in one expression are too much to be compiled
    each = cut(each)
    read = each.where("mode = 'itrans'").select("lang").distinct().collect()  # at most all languages
    done = []
    for name in sorted({r["lang"] for r in read} & set(R.LANGUAGES)):
        done.append(((F.col("lang") == name) & (F.col("mode") == "itrans"), lambda own, name=name: own.select("id", scheme.scheme_to_script(F.col("text"), name).alias("text"))))
    for name, tree in (models or {}).items():
        first = lambda words, tree=tree, name=name: predict.predict_words(words, tree, name).select("word", F.try_element_at("options", F.lit(1)).alias("out"))
        done.append(((F.col("lang") == name) & (F.col("mode") == "predictive"), lambda own, first=first: lookup.apply_per_distinct_word(own.withColumnRenamed("id", "doc_id"), first).withColumnRenamed("doc_id", "id")))
    shown = each.where(~F.coalesce(reduce(lambda x, y: x | y, (which for which, _ in done), F.lit(False)), F.lit(False))).select("id", "text")
    for which, convert in done:
        shown = shown.unionByName(convert(each.where(which).select("id", "text")))
    packed = F.sort_array(F.collect_list(F.struct("id.pos", F.coalesce("text", F.lit("")).alias("out"))))
    return shown.groupBy("id.row", "id.doc_id").agg(F.array_join(F.transform(packed, lambda x: x["out"]), "").alias("text")).drop("row")


def train_language(words: DataFrame, lang: str) -> DataFrame:
    """The trees of all letters of a language from its native (word) rows."""
    return trees.grow(romanize.training_examples(words, lang), letters.feature_groups(lang))


def next_syllable_table(docs: DataFrame, lang: str, k: int = 15) -> DataFrame:
    """The next-syllable table of a corpus of Latin text."""
    return lexicon.next_table(lexicon.native_lexicon(lexicon.word_counts(docs), lang), lang, k)


def rollup_transliterated(docs: DataFrame, lang: str) -> DataFrame:
    """``form, freq, sources`` of a corpus's words."""
    words = lexicon.word_counts(docs)
    return lexicon.rollup_by_form(words, scheme.scheme_to_script(F.col("word"), lang))


def rollup_sounded(words: DataFrame, lang: str, pron: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """``form, freq, sources`` of (word, n) rows by how the words sound, the first of the ways; a word without is left out."""
    first = sounds.sound_words(words, lang, pron, tree, first=True).select(F.col("word").alias("said"), F.try_element_at("options", F.lit(1)).alias("form"))
    return lexicon.rollup_by_form(words.join(first, F.lower("word") == F.col("said")), F.col("form"))


def _spelled(word: Column, lang: str) -> Column:
    return F.transform(scheme.script_to_scheme(word, lang), lambda s: scheme.round_trip(s, word, lang))


def reverse_words(words: DataFrame, lang: str) -> DataFrame:
    """(word, ...) native words with ``spellings``: their scheme spellings, without ``/`` where that reads the same."""
    return words.withColumn("spellings", _spelled(F.col("word"), lang))


def reverse_pairs(pairs: DataFrame, lang: str) -> DataFrame:
    """(first, second, ...) rows of two native words with ``first_spellings, second_spellings``, as ``reverse_words``; an unsupported language has the words themselves."""
    if lang not in R.LANGUAGES:
        return pairs.withColumns({f"{c}_spellings": F.array(c) for c in ("first", "second")})
    return pairs.withColumns({f"{c}_spellings": _spelled(F.col(c), lang) for c in ("first", "second")})


def reverse_words_predictive(words: DataFrame, lang: str, cap: int = romanize.CAP, start: int = 0) -> DataFrame:
    """Distinct native (word) rows with ``spellings, truncated``: how they may be typed, in order; none for a word that has no spelling.

    Of a word with very many the list has those of rank ``start`` to ``start`` + ``cap`` - 1, and ``truncated`` says that there are more.
    """
    spelled = romanize.romanizations(words, lang, cap, start=start).select("word", "truncated", F.struct("rank", F.array_join("letters", "").alias("typed")).alias("s"))
    listed = spelled.groupBy("word").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["typed"]).alias("spellings"), F.max("truncated").alias("truncated"))
    done = words.select("word").distinct().join(listed, "word", "left")
    return done.select("word", F.coalesce("spellings", F.array().cast("array<string>")).alias("spellings"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
