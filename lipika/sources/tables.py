"""Readers and writers of word lists, dictionaries, models and roll-ups; schemas are given, never inferred."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lexicon(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """``lang, word, n`` from lines of word, tab, count."""
    rows = spark.read.schema("word string, n long").option("sep", "\t").option("quote", "").csv(path)
    return rows.select(F.lit(lang).alias("lang"), F.trim("word").alias("word"), "n")


def read_word_freq(spark: SparkSession, path: str) -> DataFrame:
    """``word, freq`` from lines split at any white space."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(part[0].alias("word"), F.try_element_at(part, F.lit(2)).cast("long").alias("freq"))


def read_wordset(spark: SparkSession, path: str, lang: str, kind: str) -> DataFrame:
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).where("word <> ''").distinct()
    return words.select(F.lit(lang).alias("lang"), F.lit(kind).alias("kind"), "word")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, value``: a small rule file's lines in their order, from one row with the whole text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))


def read_overrides(spark: SparkSession, manifest: str, folder: str = "") -> DataFrame:
    """``lang, latin, options`` of the files that a manifest lists: a header line, then language and file a line.

    A file has a header line, then spelling and options a line; of lines with one spelling the last
    holds. Files are rule tables of a few lines, found below ``folder``. A manifest without files gives no rows.
    """
    part = F.split(F.trim("value"), r"\s+")
    listed = _lines(spark, manifest).where("at > 0 AND trim(value) <> ''").select(part[0].alias("lang"), part[1].alias("file")).collect()
    out = spark.createDataFrame([], "lang string, latin string, options array<string>, at int")
    for r in listed:
        lines = _lines(spark, f"{folder}/{r['file']}" if folder else r["file"]).where("at > 0 AND trim(value) <> ''")
        out = out.unionByName(lines.select(F.lit(r["lang"]).alias("lang"), F.lower(part[0]).alias("latin"), F.slice(part, 2, F.size(part)).alias("options"), "at"))
    last = Window.partitionBy("lang", "latin").orderBy(F.desc("at"))
    return out.withColumn("place", F.row_number().over(last)).where("place = 1").select("lang", "latin", "options")


def read_pron_dict(spark: SparkSession, path: str) -> DataFrame:
    """``word, phones`` from lines of word and phones; ``#`` is silent."""
    part = F.split("value", " ", 2)
    phones = F.transform(F.split(F.trim(F.try_element_at(part, F.lit(2))), " +"), lambda p: F.when(p == "#", "").otherwise(p))
    return spark.read.text(path).where(F.trim("value") != "").select(part[0].alias("word"), phones.alias("phones"))


PREDICTIVE, SOUND = "predictive", "sound"


def write_model(tree: DataFrame, path: str, lang: str, kind: str = PREDICTIVE) -> None:
    """Store a language's trees of one kind; those of other languages and kinds in the folder stay."""
    named = tree.withColumns({"lang": F.lit(lang), "kind": F.lit(kind)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang", "kind").parquet(path)


def read_model(spark: SparkSession, path: str, lang: str, kind: str = PREDICTIVE) -> DataFrame:
    return spark.read.parquet(path).where((F.col("lang") == lang) & (F.col("kind") == kind)).drop("lang", "kind")


_NODE = "struct<_id:bigint,`split-rule`:struct<`rel-index`:int,`context-id`:string,feature:string>,`context-len`:int,terminal:string,classes:string>"


def read_model_xml(spark: SparkSession, path: str, kind: str = PREDICTIVE) -> DataFrame:
    """Trees stored as XML (``tree`` elements with ``key`` and ``type``, their nodes numbered in order from left to right), as ``key,
    node, delta, feature, literals, classes``; a feature is its literals and, last, its label."""
    found = spark.read.format("xml").option("rowTag", "tree").schema(f"_key string, _type string, node array<{_NODE}>").load(path)
    rows = found.where(F.col("_type") == kind).select(F.col("_key").alias("key"), F.explode("node").alias("n"))
    literal = r"u?'([^']*)'|u?\"([^\"]*)\""
    named = F.transform(F.regexp_extract_all("n.`split-rule`.feature", F.lit(literal), F.lit(0)), lambda x: F.regexp_replace(x, r"^u?['\"]|['\"]$", ""))
    pairs = F.regexp_extract_all("n.classes", F.lit(r'\("[^"]*", \d+\)'), F.lit(0))
    classes = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r'^\("(.*)", \d+\)$', 1).alias("cls"), F.regexp_extract(x, r"(\d+)\)$", 1).cast("long").alias("n")))
    leaf = F.lower("n.terminal") == "true"
    flat = rows.select("key", F.col("n._id").alias("id"), leaf.alias("leaf"), F.col("n.`split-rule`.`rel-index`").alias("delta"), named.alias("named"), F.when(leaf, classes).alias("classes"))
    # leaves and inner nodes take turns in the order of numbers, and a node's subtree is a run of numbers around it
    return flat.groupBy("key").applyInPandas(_named_nodes, "key string, node string, delta int, feature string, literals array<string>, classes array<struct<cls:string,n:bigint>>")


def _named_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one tree, in the order they were written (a node before those below it), named by the way to them."""
    below: dict[int, list[int | None]] = {}
    way: dict[int, str] = {}
    root = None
    for node in rows["id"]:
        if root is None:
            root, way[node] = node, ""
        at = root
        while at != node:
            side = int(node > at)
            if below[at][side] is None:
                below[at][side], way[node] = node, way[at] + str(side)
            at = below[at][side]
        below[node] = [None, None]
    leaf = rows["leaf"].to_numpy(bool)
    inner = lambda values: [None if x else v for x, v in zip(leaf, values, strict=True)]
    return pd.DataFrame(
        {
            "key": rows["key"],
            "node": [way[n] for n in rows["id"]],
            "delta": pd.Series(inner(rows["delta"]), dtype="Int32", index=rows.index),
            "feature": inner(n[-1] if len(n) else None for n in rows["named"]),
            "literals": inner(list(n[:-1]) for n in rows["named"]),
            "classes": rows["classes"],
        }
    )


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").partitionBy("key").parquet(path)


def write_tsv_rollups(rollup: DataFrame, path: str) -> None:
    """Two folders of lines: form and frequency, form and its source words."""
    rollup.select(F.concat_ws("\t", "form", F.col("freq").cast("string"))).write.text(f"{path}/freq")
    rollup.select(F.concat_ws("\t", "form", F.array_join("sources", "\t"))).write.text(f"{path}/sources")


def to_response_json(word: Column, options: Column, optmap: Column, itrans: Column) -> Column:
    """A suggestion as JSON text, properly escaped: the input, its options, the letters of each predicted one, and the scheme reading."""
    entry = F.struct(F.lit(True).alias("word"), options.alias("options"), optmap.alias("optmap"))
    return F.to_json(F.struct(word.alias("inString"), F.array(entry).alias("twords"), itrans.alias("itrans")))


def export_akshara_map(table: DataFrame) -> DataFrame:
    """The next-syllable table as JSON objects of ``prev+key`` to entries, one for each key letter (rows of one object together are the whole map)."""
    entry = F.struct(F.concat_ws("+", "prev", "key").alias("k"), F.col("entries").alias("e"))
    return table.groupBy("key").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("json"))
