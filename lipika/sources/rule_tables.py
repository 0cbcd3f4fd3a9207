"""A language's rules as tables, for jobs that join to them, filter them or add rows of their own.

Patterns name letters' properties in braces; ``expand`` fills them in from the property table, so rows that a job adds to either table
are met as well. The tables have a few hundred rows for each language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters, phonemes
from ..functions import rules as R

SCHEME = "lang string, ord int, spellings array<string>, kind string, code string, letter string"
PROPERTIES = "lang string, property string, ord int, letter string"
RULES = "lang string, letter string, ord int, pattern string, options array<string>"
REWRITES = "lang string, ord int, pattern string, value string"
#: What stands for a letter itself, and for a nukta that may follow it.
OWN, NUKTA = "own", "nk"


def scheme_rules(spark: SparkSession, *langs: str) -> DataFrame:
    """The scheme's symbols: a vowel's ``code`` is its sign after a consonant, its ``letter`` what stands elsewhere."""
    return spark.createDataFrame([(lang, s.order, list(s.aliases), s.kind, s.code, s.letter) for lang in langs for s in R.symbols(lang)], SCHEME)


def letter_properties(spark: SparkSession, *langs: str) -> DataFrame:
    """Native letters by property, in order; a letter's own name is a property too."""
    return spark.createDataFrame([(lang, p, k, c) for lang in langs for p, own in letters.properties(lang).items() for k, c in enumerate(own)], PROPERTIES)


def producer_rules(spark: SparkSession, *langs: str) -> DataFrame:
    """How native letters are typed: of a letter's patterns that match the longest match holds, the first of equals."""
    return spark.createDataFrame([(lang, c, k, p, list(o)) for lang in langs for c, own in letters.rules(lang).items() for k, (p, o) in enumerate(own)], RULES)


def phoneme_rules(spark: SparkSession, *langs: str) -> DataFrame:
    """How phonemes are spelled, in the same form; ``letter`` is a phoneme."""
    return spark.createDataFrame([(lang, c, k, p, list(o)) for lang in langs for c, own in phonemes.rules(lang).items() for k, (p, o) in enumerate(own)], RULES)


def rewrite_rules(spark: SparkSession, *langs: str) -> DataFrame:
    """Rewrites of typed words before prediction, in order."""
    return spark.createDataFrame([(lang, k, p, v) for lang in langs for k, (p, v) in enumerate(letters.REWRITES[lang])], REWRITES)


def expand(rules: DataFrame, properties: DataFrame) -> DataFrame:
    """The rules with every ``{property}`` of their patterns as a class of its letters; a property of no letter matches nothing of any length."""
    filled = properties.groupBy("lang", "property").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "letter"))), lambda x: x["letter"]), ""), F.lit("]")).alias("class"))
    asked = F.regexp_extract_all("pattern", F.lit(r"\{([^{}0-9][^{}]*)\}"), F.lit(1))
    named = rules.select("lang", "letter", "ord", F.explode(F.array_distinct(asked)).alias("name"))
    lookup = F.when(F.col("name") == NUKTA, "nukta").otherwise(F.col("name"))
    met = named.withColumn("property", lookup).join(filled, ["lang", "property"], "left")
    of = F.coalesce("class", F.lit("(?:)"))
    shown = F.when(F.col("name") == OWN, F.concat(F.lit("("), "letter", F.lit(")"))).when(F.col("name") == NUKTA, F.concat(of, F.lit("?"))).otherwise(of)
    pairs = met.groupBy("lang", "letter", "ord").agg(F.collect_list(F.struct(F.concat(F.lit("{"), "name", F.lit("}")).alias("name"), shown.alias("class"))).alias("pairs"))
    put = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<name:string,class:string>>")), F.col("pattern"), lambda text, x: F.replace(text, x["name"], x["class"]))
    return rules.join(pairs, ["lang", "letter", "ord"], "left").select("lang", "letter", "ord", put.alias("pattern"), "options")


def load_rules(spark: SparkSession, *langs: str) -> dict[str, DataFrame]:
    """All rule tables of some languages: ``scheme``, ``properties``, ``producers`` (expanded), ``phonemes``, ``rewrites``."""
    properties = letter_properties(spark, *langs)
    return {"scheme": scheme_rules(spark, *langs), "properties": properties, "producers": expand(producer_rules(spark, *langs), properties), "phonemes": phoneme_rules(spark, *langs), "rewrites": rewrite_rules(spark, *langs)}
