"""Phrase collocations by sorted count streams: nothing is looked up in a hash table of phrases.

Texts are cut into blocks, each a stream of numbers that stand for its words. Level by level each
block sends its phrases with their counts, in sorted order and packed, to the parts that phrases
are dealt out to; a part merges the sorted counts of all blocks, numbers the phrases that are frequent over
all of them, and tells each block which of its own these are. There the stream of phrases of k
words becomes one of phrases of k + 1 words, each the pair (number of the first k words, number of
the last k words). A phrase is counted only where both its parts are frequent, for it cannot be
more frequent than they are, so the streams shrink from level to level.

The frequent phrases' own streams then merge in prefix order (pairs sorted by their first number)
and in suffix order (by their second) with the stream one level below: that gives the counts of a
phrase's left and right parts, and of its extensions by a word at either end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize_at

LONGEST = 5
LEAST = 100
TOP = 2000
#: Words that a task gathers before it closes its blocks; a longer text is cut into several blocks.
BLOCK_WORDS = 6_000_000
#: Parts that phrases are dealt out to, for each partition of the texts; so a part's size does not grow with the texts.
PARTS = 4
#: A block's number is its partition and its place there, in 20 bits.
_BLOCK = 20
#: Parts of a language's candidates that are cut to the first rows before these meet.
_CUTS = 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BLOCKS = "block long, lang string, own long, stream binary, part long, start long, words binary, a binary, b binary, n binary"
_COUNTS = "block long, places binary, ids binary, id long, lang string, word string, a long, b long, total long"


class _Vocabulary(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte place by byte place, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 3)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _numbered(text: str, words: _Vocabulary) -> np.ndarray:
    """A text's words by number, with a 1 after each piece; 0 is the blank between two spaces."""
    parts = text.encode().translate(_LOWER).replace(b"\n", b" \n ").split(b" ")
    got = np.fromiter(map(words.__getitem__, parts), np.int32, len(parts))
    return np.append(got[got != 0], np.int32(1))


def _dealt(part: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, first place, the entries) of entries that ``order`` sorts by part."""
    sorted_parts = part[order]
    edges = np.flatnonzero(np.diff(sorted_parts)) + 1
    start = 0
    for some in np.split(order, edges) if len(order) else []:
        yield int(sorted_parts[start]), start, some
        start += len(some)


def _word_block(block: int, lang: str, stream: np.ndarray, own: int, words: list[bytes], parts: int) -> list[dict]:
    """A block as rows: its stream (places in its own list of words, -1 between pieces), and its words with their counts, by part.

    The first ``own`` places belong to the block; what follows belongs to the next one and only
    completes phrases that begin here.
    """
    seen, local = np.unique(stream, return_inverse=True)
    kept = np.flatnonzero(seen > 1)
    own_words = [words[w] for w in seen[kept]]
    part = np.fromiter((crc32(w) % parts for w in own_words), np.int64, len(kept))
    order = np.argsort(part, kind="stable")
    place = np.full(len(seen), -1, np.int32)
    place[kept[order]] = np.arange(len(order), dtype=np.int32)
    counts = np.bincount(local[:own], minlength=len(seen))[kept]
    rows = [{"block": block, "lang": lang, "own": own, "stream": _packed(place[local])}]
    for at, start, some in _dealt(part, order):
        rows.append({"block": block, "lang": lang, "part": at, "start": start, "words": zstandard.compress(b"\n".join(own_words[k] for k in some), 3), "n": _packed(counts[some])})
    return rows


_ROW = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("own", pa.int64()), ("stream", pa.binary()), ("part", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])


def word_blocks(docs: DataFrame, parts: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(text, lang) rows as blocks of one language each: a row with the stream, and for each part a row with the words dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << _BLOCK, 0, 0
        streams: dict[str, list[np.ndarray]] = {}
        known: dict[str, _Vocabulary] = {}

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            for lang, some in streams.items():
                whole, words = np.concatenate(some), list(known[lang])
                for start in range(0, len(whole), block_words):
                    if made >= 1 << _BLOCK:
                        raise ValueError("a partition of more blocks than numbers: read it in smaller parts")
                    own = min(block_words, len(whole) - start)
                    yield pa.RecordBatch.from_pylist(_word_block(first + made, lang, whole[start : start + own + LONGEST - 1], own, words, parts), _ROW)
                    made += 1
            streams.clear()
            known.clear()
            held = 0

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                got = _numbered(text, known.setdefault(lang, _Vocabulary({b"": 0, b"\n": 1})))
                streams.setdefault(lang, []).append(got)
                held += len(got)
                if held >= block_words:
                    yield from close()
        yield from close()

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).where("text <> ''")
    return rows.mapInArrow(run, _BLOCKS)


def _told(rows: pd.DataFrame, lengths: list[int], entry: np.ndarray, ids: np.ndarray) -> dict[str, list]:
    """What each block learns from a part: which of its places have which number. ``entry``: each place's phrase; ``ids``: each phrase's number, -1 if not frequent."""
    out: dict[str, list] = {"block": [], "places": [], "ids": []}
    at = 0
    for block, start, n in zip(rows["block"], rows["start"], lengths, strict=True):
        own = ids[entry[at : at + n]]
        kept = np.flatnonzero(own >= 0)
        if len(kept):
            out["block"].append(int(block))
            out["places"].append(_packed((int(start) + kept).astype(np.int64)))
            out["ids"].append(_packed(own[kept]))
        at += n
    return out


def _numbers(part: int, totals: np.ndarray, least: int, made: int = 0) -> np.ndarray:
    kept = totals >= least
    return np.where(kept, (part << 32) + made + np.cumsum(kept) - 1, -1)


def _frame(kinds: str, *groups: dict[str, list]) -> pd.DataFrame:
    """Rows of several kinds, each a group of columns of one length; columns that a group lacks are null. Objects, so that large numbers stay exact."""
    sizes = [len(next(iter(g.values()))) for g in groups]
    names = [c.split()[0] for c in kinds.split(", ")]
    return pd.DataFrame({c: pd.Series([x for g, m in zip(groups, sizes, strict=True) for x in (g[c] if c in g else [None] * m)], dtype=object) for c in names})


def _frequent_words(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part, made, out = int(rows["part"].iloc[0]), 0, []
        for lang, own in rows.groupby("lang", sort=True):
            known = _Vocabulary()
            lists = [zstandard.decompress(w).split(b"\n") for w in own["words"]]
            entry = np.fromiter((known[w] for words in lists for w in words), np.int64)
            totals = np.zeros(len(known), np.int64)
            np.add.at(totals, entry, np.concatenate([_unpacked(n, np.int64) for n in own["n"]]))
            ids = _numbers(part, totals, least, made)
            kept = np.flatnonzero(ids >= 0)
            made += len(kept)
            names = list(known)
            out += [_told(own, list(map(len, lists)), entry, ids), {"id": ids[kept].tolist(), "lang": [lang] * len(kept), "word": [names[k].decode() for k in kept], "total": totals[kept].tolist()}]
        return _frame(_COUNTS, *out)

    return run


def _frequent_pairs(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [_unpacked(x, np.int64) for x in rows["a"]]
        a, b = np.concatenate(lists), np.concatenate([_unpacked(x, np.int64) for x in rows["b"]])
        n = np.concatenate([_unpacked(x, np.int64) for x in rows["n"]])
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        totals = np.add.reduceat(n[order], np.flatnonzero(new))
        ids = _numbers(int(rows["part"].iloc[0]), totals, least)
        kept = np.flatnonzero(ids >= 0)
        phrases = {"id": ids[kept], "a": a[order][new][kept], "b": b[order][new][kept], "total": totals[kept]}
        return _frame(_COUNTS, _told(rows, list(map(len, lists)), entry, ids), {c: x.tolist() for c, x in phrases.items()})

    return run


def _joined_up(parts: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A block's next level: the stream of pairs of neighbours that are both frequent, and the pairs with their counts, by part."""

    def run(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(told):
            return _frame(_BLOCKS)
        block, own = int(blocks["block"].iloc[0]), int(blocks["own"].iloc[0])
        stream = _unpacked(blocks["stream"].iloc[0], np.int32)
        place = np.concatenate([_unpacked(x, np.int64) for x in told["places"]])
        table = np.full(max(int(stream.max(initial=-1)), int(place.max())) + 2, -1, np.int64)
        table[place] = np.concatenate([_unpacked(x, np.int64) for x in told["ids"]])
        now = table[stream]  # -1 takes the last entry, which is -1
        both = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
        a, b = now[both], now[both + 1]
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        firsts, seconds = a[order][new], b[order][new]
        counts = np.bincount(entry[both < own], minlength=len(firsts)).astype(np.int64)
        mixed = (firsts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (seconds.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        part = ((mixed >> np.uint64(29)) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part, kind="stable")
        local = np.empty(len(firsts), np.int32)
        local[by_part] = np.arange(len(firsts), dtype=np.int32)
        # of places without a pair one in a row is enough to keep its neighbours apart
        apart = np.ones(len(both), bool)
        apart[1:] = np.diff(both) > 1
        at = np.arange(len(both)) + np.cumsum(apart) - 1
        out = np.full(int(at[-1]) + 1 if len(both) else 0, -1, np.int32)
        out[at] = local[entry]
        mine = int((both < own).sum())
        rows = [{"block": block, "own": int(at[mine - 1]) + 1 if mine else 0, "stream": _packed(out)}]
        for p, start, some in _dealt(part, by_part):
            rows.append({"block": block, "part": p, "start": start, "a": _packed(firsts[some]), "b": _packed(seconds[some]), "n": _packed(counts[some])})
        return _frame(_BLOCKS, *({c: [x] for c, x in row.items()} for row in rows))

    return run


def count_streams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """``of, words`` (all words of a language), and the streams of frequent phrases: (id, lang, word, total), then (id, a, b, total)
    of 2 words, of 3 words and so on; last, the paths of their tables."""
    spark = docs.sparkSession
    parts = PARTS * max(docs.rdd.getNumPartitions(), 1)
    blocks, path = materialize_at(word_blocks(docs, parts, block_words), "phrase-words")
    unpacked = F.udf(lambda n: int(_unpacked(n, np.int64).sum()), "long")  # a value for each packed row
    sizes, sizes_at = materialize_at(blocks.where("part IS NOT NULL").groupBy(F.col("lang").alias("of")).agg(F.sum(unpacked("n")).alias("words")), "phrase-sizes")
    count, keys, out, paths = _frequent_words(least), ["lang", "word"], [], [sizes_at]
    for k in range(1, longest + 1):
        found, found_at = materialize_at(blocks.where("part IS NOT NULL").groupBy("part").applyInPandas(count, _COUNTS), f"phrase-counts-{k}")
        paths.append(found_at)
        out.append(found.where("id IS NOT NULL").select("id", *keys, "total"))
        if k < longest:
            streams = blocks.where("stream IS NOT NULL").select("block", "own", "stream").groupBy("block")
            told = found.where("block IS NOT NULL").select("block", "places", "ids").groupBy("block")
            blocks, later = materialize_at(streams.cogroup(told).applyInPandas(_joined_up(parts), _BLOCKS), f"phrase-pairs-{k + 1}")
            drop_path(spark, path)
            path, count, keys = later, _frequent_pairs(least), ["a", "b"]
    drop_path(spark, path)
    return sizes, out, paths


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exactly, in decimals of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(1000).cast("decimal(4,0)") * wide(n), wide(left) * wide(right))


def score_phrases(sizes: DataFrame, streams: list[DataFrame]) -> DataFrame:
    """Each frequent phrase with ``lang, phrase, a, l, r, n, score, longest`` (the count of its most frequent extension, null without).

    A level's table has, besides a phrase's words, the counts of all its beginnings and ends, which
    its extensions take over.
    """
    first = streams[0]
    below = first.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "total", F.array("total").alias("begins"), F.array("total").alias("ends"))
    out = []
    for k, pairs in enumerate(streams[1:], 2):
        left = below.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), "begins")
        right = below.select(F.col("id").alias("b"), "last", "ends")
        # in prefix order, then in suffix order, in step with the stream below
        level = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        level = level.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "total", F.concat("begins", F.array("total")).alias("begins"), F.concat("ends", F.array("total")).alias("ends"))
        level, _ = materialize_at(level, f"phrase-level-{k}")
        if k < len(streams):
            above = streams[k]
            longer = above.select(F.col("a").alias("of"), "total").unionByName(above.select(F.col("b").alias("of"), "total")).groupBy("of").agg(F.max("total").alias("longest"))
            done = level.join(longer.hint("merge"), level["id"] == longer["of"], "left").drop("of")
        else:
            done = level.withColumn("longest", F.lit(None).cast("long"))
        out.append(done.withColumn("k", F.lit(k)))
        below = level
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    sized = found.join(F.broadcast(sizes), F.col("lang") == F.col("of")).withColumnRenamed("words", "n")
    part = lambda j: F.struct(_score(F.col("total"), F.col("n"), F.element_at("begins", j), F.element_at("ends", F.col("k") - j)).alias("score"), j.alias("cut"))
    least = F.array_min(F.transform(F.sequence(F.lit(1), F.col("k") - 1), part))
    scored = sized.withColumn("least", least).withColumn("cut", F.col("least.cut"))
    return scored.select("lang", "phrase", F.col("total").alias("a"), F.element_at("begins", F.col("cut")).alias("l"), F.element_at("ends", F.col("k") - F.col("cut")).alias("r"), "n", F.col("least.score").cast("long").alias("score"), "longest")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(text, lang, ...) rows to ``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases of 2 to ``longest`` words.

    A phrase stands within a piece (pieces end at ``.,;:!?`` and line ends), at least ``least`` times
    (``a``). Of its cuts into two parts (counts ``l`` and ``r``) the one with the least
    floor(1000 a n / (l r)) counts, the first of equals. A phrase goes if a longer one that holds it is as
    frequent; a longer one is no more frequent than what it holds, so it is enough to look at
    extensions by one word. Null texts are empty, a null language is ``und``, repeated rows count
    again, an empty table gives no row; other columns are not looked at.
    """
    sizes, streams, paths = count_streams(docs, least, longest, block_words)
    kept = score_phrases(sizes, streams).where(F.col("longest").isNull() | (F.col("longest") < F.col("a"))).drop("longest")
    best = lambda *key: Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("a"), "phrase")
    parts = kept.withColumn("part", F.pmod(F.hash("phrase"), F.lit(_CUTS)))
    few = parts.withColumn("rank", F.row_number().over(best("lang", "part"))).where(F.col("rank") <= top)
    ranked, _ = materialize_at(few.withColumn("rank", F.row_number().over(best("lang")).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for path in paths:
        drop_path(docs.sparkSession, path)
    return ranked
