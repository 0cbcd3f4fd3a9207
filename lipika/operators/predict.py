"""Typed Latin words to ranked native words with trained trees: prediction, suggestions, alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters, scheme, text
from ..functions import rules as R
from . import lookup, ranking, romanize, trees

_END = "\u0001"


def _chars(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s:.)"), F.lit(0))


def _optmap(options: Column, chars: Column) -> Column:
    """Letters by option, of predicted options and their letters in the same order; of equal options the last one's."""
    letters_of = lambda o: F.element_at(chars, (F.size(options) - F.array_position(F.reverse(options), o) + 1).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(options), lambda o: F.struct(o.alias("key"), letters_of(o).alias("value"))))


def typed_windows(words: DataFrame, lang: str, scope: int = trees.SCOPE) -> DataFrame:
    """``typed, pos, key, window, offset`` of the letters of (typed) words."""
    ahead = trees.reach(scope, letters.feature_groups(lang))
    marked = F.concat(F.lit("#"), F.col("typed"), F.lit("_"))
    at = words.select("typed", F.posexplode(_chars(F.col("typed"))).alias("pos", "key"))
    start = F.greatest(F.col("pos") + 1 - scope, F.lit(0))
    return at.select("typed", "pos", "key", F.substr(marked, start + 1, F.col("pos") + 2 + ahead - start).alias("window"), (F.col("pos") + 1 - start).alias("offset"))


def predict_words(words: DataFrame, tree: DataFrame, lang: str, exact: DataFrame | None = None) -> DataFrame:
    """Distinct (word[, single_at]) rows with ``typed, options, chars, valid``: native words, those of the likeliest classes first.

    A word of ``exact`` (typed, native) is that native word. Else each letter's classes are taken
    from its tree, by frequency (only the first at ``single_at``); a letter without a tree adds
    nothing; all their joins are made, or beyond 100 that of the first ones; valid words stay, and
    if none is valid the first join does, with ``valid`` 0. ``chars`` has each option letter by letter.
    """
    single = F.col("single_at") if "single_at" in words.columns else F.lit(None).cast("int")
    asked = words.select("word", single.cast("int").alias("single_at")).where("word IS NOT NULL AND word <> ''").distinct().withColumn("typed", text.preprocess(F.col("word"), lang))
    left = asked
    if exact is not None:
        known = exact.groupBy("typed").agg(F.min("native").alias("native"))
        left = asked.join(known, "typed", "left_anti")
    found = trees.predict(typed_windows(left.select("typed").distinct(), lang), tree)
    joined = left.join(_chains(found, "typed"), "typed")
    made = joined.select("word", "single_at", "typed", text.expand_options(_chosen(F.col("all"), F.col("single_at"))).alias("made"))
    out = _valid_first(made, ["word", "single_at", "typed"], lang)
    if exact is None:
        return out
    direct = asked.join(known, "typed").select("word", "single_at", "typed", F.array("native").alias("options"), F.array(_chars(F.col("native"))).alias("chars"), F.lit(1).alias("valid"))
    return out.unionByName(direct)


def _chains(found: DataFrame, *by: str) -> DataFrame:
    """``all``: each letter's classes in order, by frequency; a letter without a tree adds nothing."""
    classes = F.transform("classes", lambda c: F.when(c["cls"] == letters.EPSILON, "").otherwise(c["cls"]))
    own = found.withColumn("o", F.coalesce(classes, F.array(F.lit(""))))
    return own.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]).alias("all"))


def _chosen(chain: Column, single_at: Column | None = None) -> Column:
    """The classes to join, each with its end marked; only the first at ``single_at``."""
    own = lambda o, i: o if single_at is None else F.when(i == single_at, F.slice(o, 1, 1)).otherwise(o)
    return F.transform(chain, lambda o, i: F.transform(own(o, i), lambda x: F.concat(x, F.lit(_END))))


def _valid_first(made: DataFrame, by: list[str], lang: str | None) -> DataFrame:
    """``options, chars, valid`` of joined classes (``made``): valid words, or the first join with ``valid`` 0; without a language all are valid."""
    plain = lambda x: F.replace(x, F.lit(_END), F.lit(""))
    split = lambda x: F.slice(F.split(x, _END), 1, F.size(F.split(x, _END)) - 1)
    good = F.col("made") if lang is None else F.filter("made", lambda x: scheme.is_valid_word(plain(x), lang))
    kept = made.withColumn("good", good).select(*by, F.when(F.size("good") > 0, F.col("good")).otherwise(F.slice("made", 1, 1)).alias("made"), F.size("good").alias("valid"))
    return kept.select(*by, F.transform("made", plain).alias("options"), F.transform("made", split).alias("chars"), "valid")


def predict_symbols(words: DataFrame, tree: DataFrame, codes: dict[str, str], lang: str | None = None, exact: DataFrame | None = None) -> DataFrame:
    """Distinct (symbols) rows with ``typed, options, chars, valid``, for input whose symbols have codes of one or more letters.

    ``typed`` is the codes joined. Each symbol is predicted by the tree of its code's first letter, where its code begins in
    ``typed``; the trees have learned from texts coded alike. A word with a symbol that has no code is its own only option, with
    ``valid`` -1. A word of ``exact`` (typed, chars) is that. Without a language every join counts as valid. Nulls and empty rows give none.
    """
    coded = lookup.encode_symbols(F.col("symbols"), codes)
    asked = words.select("symbols").where("size(symbols) > 0 AND NOT exists(symbols, x -> x IS NULL)").distinct().withColumn("c", coded)
    unknown = asked.where("c.n < 0").select("symbols", F.array_join("symbols", "").alias("typed"), F.array(F.array_join("symbols", "")).alias("options"), F.array("symbols").alias("chars"), F.lit(-1).alias("valid"))
    left = asked.where("c.n >= 0").select("symbols", F.col("c.word").alias("typed"))
    known = None
    if exact is not None:
        known = exact.groupBy("typed").agg(F.min("chars").alias("own"))
        direct = left.join(known, "typed").select("symbols", "typed", F.array(F.array_join("own", "")).alias("options"), F.array("own").alias("chars"), F.lit(1).alias("valid"))
        left = left.join(known, "typed", "left_anti")
    ahead = trees.SCOPE + (tree.agg(F.max(F.array_max(F.transform("literals", F.char_length)))).first()[0] or 1) - 1
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    parts = left.withColumn("parts", F.transform("symbols", lambda x: F.try_element_at(table, x)))
    at = parts.select("symbols", "typed", "parts", F.posexplode("parts").alias("pos", "code"))
    at = at.withColumn("focus", F.char_length(F.array_join(F.slice("parts", 1, F.col("pos")), "")))
    start = F.greatest(F.col("focus") + 1 - trees.SCOPE, F.lit(0))
    marked = F.concat(F.lit("#"), F.col("typed"), F.lit("_"))
    windows = at.select("symbols", "typed", "pos", F.substr("code", F.lit(1), F.lit(1)).alias("key"), F.substr(marked, start + 1, F.col("focus") + 2 + ahead - start).alias("window"), (F.col("focus") + 1 - start).alias("offset"))
    chains = _chains(trees.predict(windows, tree), "symbols", "typed")
    out = _valid_first(chains.select("symbols", "typed", text.expand_options(_chosen(F.col("all"))).alias("made")), ["symbols", "typed"], lang).unionByName(unknown)
    return out if known is None else out.unionByName(direct)


def suggest(
    words: DataFrame, lang: str, tree: DataFrame | None = None, lexicon: DataFrame | None = None, sounds: DataFrame | None = None, english: DataFrame | None = None, clash: DataFrame | None = None, overrides: DataFrame | None = None, exact: DataFrame | None = None
) -> DataFrame:
    """Distinct ``word`` with ``options, optmap, itrans``: predicted words, those of the lexicon first; then the sounded-out
    candidate where it belongs (``sounds``: lower-case word and options; only for words without scheme marks and digits),
    and an override's first option before all others. ``optmap`` has the letters of each predicted option. ``itrans`` is the
    scheme reading, in which case matters. A language that isn't supported has the lower-case input as its only option."""
    asked = words.select("word").where("word IS NOT NULL AND word <> ''").distinct().withColumn("lower", F.lower("word"))
    if lang not in R.LANGUAGES or tree is None:
        return asked.select("word", F.array("lower").alias("options"), F.create_map("lower", F.array("lower")).alias("optmap"), F.col("word").alias("itrans"))
    ranked = predict_words(asked.select(F.col("lower").alias("word")), tree, lang, exact).select(F.col("word").alias("lower"), "options", _optmap(F.col("options"), F.col("chars")).alias("optmap"))
    if lexicon is not None:
        known = lookup.flag_dictionary(ranked.select(F.col("lower").alias("id"), "options"), lexicon)
        ranked = ranked.join(known.select(F.col("id").alias("lower"), "known"), "lower").withColumn("options", ranking.dictionary_first(F.col("options"), F.col("known"))).drop("known")
    if sounds is not None:
        sounds = sounds.where("rank = 0") if "rank" in sounds.columns else sounds  # a word's first row
        first = sounds.groupBy(F.col("word").alias("lower")).agg(F.min(F.try_element_at("options", F.lit(1))).alias("candidate"))
        none = ranked.select(F.lit("").alias("word")).limit(0)
        flagged = lookup.clash_flags(ranked.join(first, "lower", "left").withColumnRenamed("lower", "word"), english if english is not None else none, clash if clash is not None else none).withColumnRenamed("word", "lower")
        use = F.when(text.is_plain_latin(F.col("lower")) & (F.col("candidate") != ""), F.col("candidate"))
        ranked = flagged.withColumn("options", ranking.insert_sound_candidate(F.col("options"), use, F.col("english"), F.col("clash"))).select("lower", "options", "optmap")
    if overrides is not None:
        done = lookup.apply_overrides(ranked.select(F.col("lower").alias("latin"), "options"), overrides)
        ranked = ranked.drop("options").join(done.withColumnRenamed("latin", "lower"), "lower")
    return asked.join(ranked, "lower").select("word", "options", "optmap", scheme.scheme_to_script(F.col("word"), lang).alias("itrans"))


def top_suggestion(suggestions: DataFrame) -> DataFrame:
    return suggestions.select("word", F.try_element_at("options", F.lit(1)).alias("option"))


def alternatives_at(words: DataFrame, tree: DataFrame, lang: str) -> DataFrame:
    """(chars: native word letter by letter as typed, latin, pos) rows with ``options``: the words that other classes of one typed letter make.

    Every class known for the letter is tried, in the order of its leaves; valid words that can be
    spelled like the input stay; if the present word isn't among them, only it does.
    """
    ranked = trees.alternate_classes(tree).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("leaves")).alias("m"), "cls"))), lambda x: x["cls"]).alias("others"))
    asked = words.select("chars", "latin", F.col("pos").cast("long").alias("pos")).distinct()
    at = asked.join(romanize.preprocess_with_focus(asked.select(F.col("latin").alias("word"), F.col("pos").alias("focus")), lang).withColumnsRenamed({"word": "latin", "focus": "pos"}), ["latin", "pos"])
    at = at.withColumn("key", F.substr("typed", F.col("at") + 1, F.lit(1))).join(ranked, "key", "left")
    swap = lambda c: F.array_join(F.transform("chars", lambda x, i: F.when(i == F.col("at"), F.when(c == letters.EPSILON, "").otherwise(c)).otherwise(x)), "")
    made = at.select("chars", "latin", "pos", "typed", F.posexplode(F.transform(F.coalesce("others", F.array().cast("array<string>")), swap)).alias("rank", "made")).where(scheme.is_valid_word(F.col("made"), lang))
    spelled = romanize.align_pair(made.select(F.col("typed").alias("literal"), F.col("made").alias("word")), lang).where("exact").select(F.col("literal").alias("typed"), F.col("word").alias("made"))
    kept = made.join(spelled, ["typed", "made"]).groupBy("chars", "latin", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "made"))), lambda x: x["made"]).alias("found"))
    native = F.array_join("chars", "")
    joined = asked.join(kept, ["chars", "latin", "pos"], "left")
    return joined.select("chars", "latin", "pos", F.when(F.array_contains("found", native), F.array_distinct("found")).otherwise(F.array(native)).alias("options"))


def alternatives_in_words(words: DataFrame, tree: DataFrame, lang: str) -> DataFrame:
    """Distinct (word, latin) rows, a native word and what was typed for it, to ``word, latin, pos, options`` for every typed letter.

    The word's letters are those of its spelling that is the input, as it was typed or rewritten. A word without
    such a spelling, or without any, has itself as its only option, at every letter. Nulls and empty inputs give no row.
    """
    asked = words.select("word", "latin").where("word IS NOT NULL AND word <> '' AND latin <> ''").distinct()
    literals = asked.select("word", "latin", F.explode(F.array_distinct(F.array(F.struct(F.lit(0).alias("rank"), F.col("latin").alias("literal")), F.struct(F.lit(1).alias("rank"), text.preprocess(F.col("latin"), lang).alias("literal"))))).alias("l")).select("word", "latin", "l.*")
    found = romanize.align_pair(literals.select("literal", "word"), lang).where("exact")
    chosen = literals.join(found, ["literal", "word"]).groupBy("word", "latin").agg(F.min(F.struct("rank", text.strip_epsilon(F.col("classes")).alias("chars"))).alias("best"))
    each = asked.select("word", "latin", F.explode(F.sequence(F.lit(0).cast("long"), F.char_length("latin").cast("long") - 1)).alias("pos"))
    placed = each.join(chosen.select("word", "latin", F.col("best.chars").alias("chars")), ["word", "latin"], "left")
    options = alternatives_at(placed.where("chars IS NOT NULL"), tree, lang).select("chars", "latin", "pos", "options")
    done = placed.join(options, ["chars", "latin", "pos"], "left")
    return done.select("word", "latin", "pos", F.coalesce("options", F.array("word")).alias("options"))
