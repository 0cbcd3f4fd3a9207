"""Spelling variants by a dictionary of trie-node pairs.

Words are numbered twice: each prefix is a node of the trie of words, each suffix a node of the
trie of reversed words. A word is a pair (prefix node, suffix node) at each of its positions; with
one letter skipped it is the pair of the prefix before and the suffix after it. Two words that
share a skipped pair differ by one replaced letter; a word whose skipped pair is another word's
plain pair has one letter more. That finds exactly the neighbours within one edit, by integers alone.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize, materialize_at

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST = 5
LEAST = 3
#: One in so many occurrences loses a letter, in the query's input.
DAMAGE = 97
#: Words of a trie part, on average; there are at most ``MOST_PARTS`` of them, each a stream, so their size needs no bound.
PART_WORDS = 50_000
MOST_PARTS = 4_096
#: Code points of the strings that part the tries.
SPLIT_CHARS = 16
_SEQ = 40


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) rows to (doc_id, run): maximal runs of letters with only A-Z lower-cased, a row for each occurrence."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))


def damaged(doc_id: Column, run: Column, every: int = DAMAGE) -> Column:
    """The run, or without one of its letters where ``every`` divides the checksum of document and run; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), k), F.substr(run, k + 2))).otherwise(run)


def count_words(words: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(word) rows to ``word, n``, of words of at least ``shortest`` code points that occur at least ``least`` times."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _splits(words: DataFrame, column: Column, parts: int, n: int) -> list[str]:
    """At most ``parts`` - 1 strings that part the words about evenly, from some 20 words a part chosen by their hash."""
    if parts < 2:
        return []
    share = max(1, n // (parts * 20))
    head = F.substr(column, F.lit(1), F.lit(SPLIT_CHARS)).alias("s")
    some = sorted(r["s"] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select(head).limit(parts * 60).collect())
    return sorted({some[i * len(some) // parts] for i in range(1, parts)}) if some else []


def _parted(words: DataFrame, key: Column, splits: list[str]) -> DataFrame:
    """The words by trie part, in code-point order of ``key`` within it."""
    with_key = words.withColumn("key", key)
    schema = with_key.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([bisect_right(splits, k) for k in batch.column("key").to_pylist()], pa.int64()))

    named = with_key.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", part long")
    return named.repartition(max(1, len(splits) + 1), "part").sortWithinPartitions("part", "key")


class _Trie:
    """Numbers the nodes of one part's words, which come in order; only the last word's nodes are kept.

    A prefix that words of several parts share lies on the path to the string that parts them,
    so these few prefixes have numbers of their own, below zero; the root is 0.
    """

    def __init__(self, splits: list[str]) -> None:
        self.shared = {p: -1 - i for i, p in enumerate(sorted({s[:k] for s in splits for k in range(1, len(s) + 1)}))}
        self.deepest = max(map(len, splits), default=0)
        self.part, self.word, self.nodes, self.made, self.seen = -1, "", [0], 0, 0

    def add(self, part: int, word: str) -> tuple[int, list[int]]:
        """The word's number, in order, and the nodes of its prefixes."""
        if part != self.part:
            self.part, self.word, self.nodes, self.made, self.seen = part, "", [0], part << _SEQ, part << _SEQ
        k = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(word, self.word, strict=False)))
        nodes = self.nodes[: k + 1]
        for depth in range(k + 1, len(word) + 1):
            known = self.shared.get(word[:depth]) if depth <= self.deepest else None
            if known is None:
                self.made += 1
                known = self.made
            nodes.append(known)
        self.word, self.nodes = word, nodes
        self.seen += 1
        return self.seen, nodes


def number_nodes(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n) rows to ``id, word, n, heads, tails, fresh``: ids in code-point order, the trie nodes of all prefixes
    (shortest first) and of all suffixes (longest first), and whether a letter differs from the one before it."""
    n = words.count()
    parts = min(MOST_PARTS, math.ceil(n / part_words))
    ahead = _splits(words, F.col("word"), parts, n)
    behind = _splits(words, F.reverse("word"), parts, n)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(ahead)
        for batch in batches:
            got = [trie.add(part, word) for part, word in zip(batch.column("part").to_pylist(), batch.column("word").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), batch.column("word"), batch.column("n"), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["id", "word", "n", "heads"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(behind)
        for batch in batches:
            own = batch.column("word").to_pylist()
            tails = [trie.add(part, key)[1][::-1] for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            fresh = [[True, *(a != b for a, b in zip(w, w[1:], strict=False))] for w in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "word", "n", "heads")), pa.array(tails, pa.list_(pa.int64())), pa.array(fresh, pa.list_(pa.bool_()))], ["id", "word", "n", "heads", "tails", "fresh"])

    numbered = _parted(words, F.col("word"), ahead).mapInArrow(forward, "id long, word string, n long, heads array<long>")
    numbered, path = materialize_at(numbered, "word-heads")
    out = materialize(_parted(numbered, F.reverse("word"), behind).mapInArrow(backward, "id long, word string, n long, heads array<long>, tails array<long>, fresh array<boolean>"), "word-nodes")
    drop_path(words.sparkSession, path)
    return out


def near_words(nodes: DataFrame) -> DataFrame:
    """``id, n_near, best`` of words that have a near one; ``best`` is the struct (n, -id) of the most frequent, of equals the first.

    A pair of nodes has at most one word and, of words with a letter skipped there, one for each
    letter of the alphabet, so groups are small; no pair of words is made.
    """
    size = F.size("fresh")
    node = lambda name, i: F.element_at(name, i + 1)
    plain = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(node("heads", i).alias("head"), node("tails", i).alias("tail"), F.lit(0).alias("kind")))
    # of a doubled letter only the first is skipped for the shorter word, so that a pair of words meets once
    skip = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(node("heads", i).alias("head"), node("tails", i + 1).alias("tail"), F.when(node("fresh", i), 2).otherwise(1).alias("kind")))
    each = nodes.select("id", "n", F.explode(F.concat(plain, skip)).alias("p")).select("p.head", "p.tail", F.struct("n", (-F.col("id")).alias("neg"), F.col("p.kind").alias("kind")).alias("m"))
    groups = each.groupBy("head", "tail").agg(F.collect_list("m").alias("ms")).where(F.size("ms") > 1)
    skips = F.reverse(F.array_sort(F.filter("ms", lambda m: m["kind"] > 0)))
    groups = groups.withColumn("skips", skips).withColumn("whole", F.try_element_at(F.filter("ms", lambda m: m["kind"] == 0), F.lit(1)))
    groups = groups.withColumn("fresh", F.filter("skips", lambda m: m["kind"] == 2))
    groups = groups.select("skips", "whole", "fresh", F.explode("ms").alias("m"))
    first, second = F.try_element_at("skips", F.lit(1)), F.try_element_at("skips", F.lit(2))
    pair = lambda m: F.struct(m["n"].alias("n"), m["neg"].alias("neg"))
    other = pair(F.when(F.col("m.neg") == first["neg"], second).otherwise(first))
    beside = F.when((F.col("m.kind") == 0) | (F.size("skips") < 2), F.lit(None)).otherwise(other)
    longer = F.when((F.col("m.kind") == 0) & (F.size("fresh") > 0), pair(F.try_element_at("fresh", F.lit(1))))
    shorter = F.when((F.col("m.kind") == 2) & F.col("whole").isNotNull(), pair(F.col("whole")))
    near = F.when(F.col("m.kind") == 0, F.size("fresh")).otherwise(F.size("skips") - 1 + shorter.isNotNull().cast("int"))
    found = groups.select((-F.col("m.neg")).alias("id"), near.cast("long").alias("near"), F.array_max(F.array(beside, longer, shorter)).alias("best")).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def follow_forms(links: DataFrame) -> DataFrame:
    """(id, form) rows to ``id, root``, the last word of each chain. A form is at least twice as frequent, so chains are short and
    have no cycle; each round halves what is left of them."""
    now, path = materialize_at(links.select("id", F.col("form").alias("root")), "form-roots")
    while True:
        step = now.select(F.col("id").alias("at"), F.col("root").alias("next"))
        on = now.join(step, now["root"] == step["at"], "left")
        then, later = materialize_at(on.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "form-roots")
        moved = bool(then.where("moved").head(1))
        drop_path(links.sparkSession, path)
        now, path = then.select("id", "root"), later
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = 2, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n) rows, each word once, to ``word, form, root, n, n_near, form_n``.

    Words are near if one inserted, deleted or replaced code point makes one the other. A word's form is its near word
    of largest n, of equals the first in code-point order, if that n is at least ``ratio`` (2 or more) times its own, else null;
    its root is the last word of the chain of forms, or itself. A null or empty word gives no row; an empty
    table gives none; other columns are not looked at. Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words")
    spark: SparkSession = words.sparkSession
    counted, at = materialize_at(words.where("word IS NOT NULL AND word <> ''").select("word", F.col("n").cast("long").alias("n")), "variant-words")
    nodes = number_nodes(counted, part_words)
    known = nodes.select("id", "word", "n")
    near, near_at = materialize_at(near_words(nodes).select(F.col("id").alias("near_id"), "n_near", F.col("best.n").alias("best_n"), (-F.col("best.neg")).alias("best_id")), "near-words")
    drop_path(spark, at)
    joined = known.join(near, known["id"] == near["near_id"], "left")
    formed = joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(to) for c, to in (("best_id", "form_id"), ("best_n", "form_n"))])
    formed, formed_at = materialize_at(formed, "variant-forms")
    drop_path(spark, near_at)
    roots = follow_forms(formed.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("form"))).select(F.col("id").alias("of"), F.col("root").alias("root_id"))
    name = lambda of, to: known.select(F.col("id").alias(of), F.col("word").alias(to))
    linked = formed.where("form_id IS NOT NULL").join(roots, F.col("id") == F.col("of"))
    linked = linked.join(name("f", "form"), F.col("form_id") == F.col("f")).join(name("r", "root"), F.col("root_id") == F.col("r"))
    alone = formed.where("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return linked.select("word", "form", "root", "n", "n_near", "form_n").unionByName(alone)
