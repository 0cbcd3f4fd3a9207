"""Words to phones: letters and phones of a pronouncing dictionary are aligned, and trees learn the phones of letters in context.

A letter stands for no phone, one, or two; letters and phones go in the same order. How likely a
letter has which phones is learned by expectation rounds over the whole dictionary: each round sums, over all
alignments of all words, how often a letter has them. The likeliest alignment of each word then is what the trees learn from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import letters
from ..sources.scratch import cut
from . import lookup, romanize, trees

ROUNDS = 6
#: Two phones of one letter are written with this between them, as pronunciations have it.
JOINED = "_"
# Groups of letters that the trees may ask for.
GROUPS: trees.Groups = [("vowel", list("aeiouy")), ("front vowel", list("eiy")), ("stop", list("pbtdkgcq")), ("liquid", list("lr")), ("nasal", list("mn")), ("cons", list("bcdfghjklmnpqrstvwxz"))]
#: Letters by phones of the words that are aligned at once.
CELLS = 500_000
Chances = dict[str, dict[str, float]]


class _Alignments:
    """All alignments of a batch's words with their phones at once: words of one length with one number of phones are rows of arrays.

    What a letter may stand for (it, the first phone, the second; none is 0) is a number, and ``values`` are those that occur.
    """

    def __init__(self, words: pa.Array, phones: pa.Array, chances: Chances | None):
        spelled = words.to_pylist()
        letters, sizes = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32), np.array(list(map(len, spelled)), np.int64)
        alphabet, of = np.unique(letters, return_inverse=True)
        said = phones.flatten().dictionary_encode()
        own, counts = said.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, phones.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.base = len(said.dictionary) + 1
        self.groups = []
        first, after = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
        order = np.lexsort((counts, sizes))
        ends = np.flatnonzero(np.diff(sizes[order]) | np.diff(counts[order])) + 1
        for rows in np.split(order, ends) if len(order) else []:
            n, m = int(sizes[rows[0]]), int(counts[rows[0]])
            if n and m <= 2 * n:
                step = max(1, CELLS // (n * (m + 1)))
                for part in (rows[k : k + step] for k in range(0, len(rows), step)):
                    self.groups.append((part, *self._codes(of[first[part, None] + np.arange(n)], own[after[part, None] + np.arange(m)])))
        self.values = np.unique(np.concatenate([np.unique(x) for _, *codes in self.groups for x in codes])) if self.groups else np.zeros(0, np.int64)
        self.letters = [chr(alphabet[x // self.base**2]) for x in self.values]
        names = said.dictionary.to_pylist()
        self.names = [JOINED.join(names[x - 1] for x in divmod(int(v) % self.base**2, self.base) if x) for v in self.values]
        self.chance = np.array([1.0 if chances is None else chances.get(a, {}).get(b, 0.0) for a, b in zip(self.letters, self.names, strict=True)])

    def _codes(self, letters: np.ndarray, phones: np.ndarray) -> list[np.ndarray]:
        """Numbers by word, letter and phones used up, of letters that take none, one and two."""
        at = letters.astype(np.int64)[:, :, None] * self.base**2
        one, two = phones[:, None, :] * self.base, phones[:, None, :-1] * self.base + phones[:, None, 1:]
        return [at, at + one, at + two]

    def each(self) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray], int, int]]:
        """(rows, places in ``values``, chances, letters, phones) of each group."""
        for rows, *codes in self.groups:
            places = [np.searchsorted(self.values, x) for x in codes]
            yield rows, places, [self.chance[x] for x in places], codes[1].shape[1], codes[1].shape[2]

    def expected(self) -> np.ndarray:
        """How often each of ``values`` is in the alignments, each by its probability; a word without any adds nothing."""
        sums = np.zeros(len(self.values))
        with np.errstate(all="ignore"):
            for rows, places, chance, n, m in self.each():
                ahead, behind = np.zeros((n + 1, len(rows), m + 1)), np.zeros((n + 1, len(rows), m + 1))
                ahead[0, :, 0] = behind[n, :, m] = 1.0
                for k in range(n):
                    for took in range(min(2, m) + 1):
                        ahead[k + 1, :, took:] += ahead[k, :, : m + 1 - took] * chance[took][:, k]
                for k in range(n - 1, -1, -1):
                    for took in range(min(2, m) + 1):
                        behind[k, :, : m + 1 - took] += chance[took][:, k] * behind[k + 1, :, took:]
                total = ahead[n, :, m, None]
                for k in range(n):
                    for took in range(min(2, m) + 1):
                        share = ahead[k, :, : m + 1 - took] * chance[took][:, k] * behind[k + 1, :, took:] / total
                        at = np.broadcast_to(places[took][:, k], share.shape)
                        good = share > 0
                        sums += np.bincount(at[good], share[good], len(sums))
        return sums

    def likeliest(self, size: int) -> list[list[str] | None]:
        """Each letter's phones in the likeliest alignment of each of ``size`` words, of equals the one whose first differing letter has fewer; None if there is none."""
        found: list[list[str] | None] = [None] * size
        names = np.array([*self.names, ""], object)
        with np.errstate(divide="ignore"):
            for rows, places, chance, n, m in self.each():
                best, turn = np.full((len(rows), m + 1), -np.inf), np.zeros((n, len(rows), m + 1), np.int8)
                best[:, m] = 0.0
                for k in range(n - 1, -1, -1):
                    now = np.full_like(best, -np.inf)
                    for took in range(min(2, m) + 1):
                        score = np.log(chance[took][:, k]) + best[:, took:]
                        better = score > now[:, : m + 1 - took] + 1e-12
                        now[:, : m + 1 - took][better] = score[better]
                        turn[k, :, : m + 1 - took][better] = took
                    best = now
                fits = np.flatnonzero(best[:, 0] > -np.inf)
                at, own = np.zeros(len(fits), np.int64), np.empty((len(fits), n), np.int64)
                for k in range(n):
                    took = turn[k, fits, at]
                    for t in range(min(2, m) + 1):
                        of = np.flatnonzero(took == t)
                        own[of, k] = places[t][fits[of], k, at[of] if t else 0]
                    at += took
                for row, value in zip(rows[fits].tolist(), names[own].tolist(), strict=True):
                    found[row] = value
        return found


def _alone(word: str, phones: list[str], chances: Chances | None) -> _Alignments:
    return _Alignments(pa.array([word], pa.string()), pa.array([phones], pa.list_(pa.string())), chances)


def expected(word: str, phones: list[str], chances: Chances | None) -> dict[tuple[str, str], float]:
    """How often each letter of one word has which phones, over all its alignments, each by its probability; nothing for a word with none."""
    found, out = _alone(word, phones, chances), {}
    for letter, name, n in zip(found.letters, found.names, found.expected().tolist(), strict=True):
        if n > 0:
            out[letter, name] = out.get((letter, name), 0.0) + n
    return out


def likeliest(word: str, phones: list[str], chances: Chances) -> list[str] | None:
    """Each letter's phones in one word's likeliest alignment; None if there is none."""
    return _alone(word, phones, chances).likeliest(1)[0]


def align_phones(pron: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Distinct (word, phones) rows with ``own``: each letter's phones, joined by ``_``, blank for none.

    Blank phones and ``#`` are left out beforehand; words are lower-cased. A word with more than two phones a letter, or
    without letters, gives no row. The table of chances is a letter's by its phones, so it does not grow with the dictionary.
    """
    clean = F.filter("phones", lambda p: p.isNotNull() & ~p.isin("", "#"))
    rows = cut(pron.where("word IS NOT NULL AND word <> '' AND phones IS NOT NULL").select(F.lower("word").alias("word"), clean.alias("phones")).distinct())
    chances: Chances | None = None
    for _ in range(rounds):
        known = rows.sparkSession.sparkContext.broadcast(chances)

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _Alignments(batch.column("word"), batch.column("phones"), known.value)
                n = found.expected()
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([found.letters[k] for k in seen], pa.string()), pa.array([found.names[k] for k in seen], pa.string()), pa.array(n[seen], pa.float64())], ["letter", "name", "n"])

        sums = rows.mapInArrow(count, "letter string, name string, n double").groupBy("letter", "name").agg(F.sum("n").alias("n")).orderBy("letter", "name").collect()
        counts: Chances = {}
        for r in sums:
            counts.setdefault(r["letter"], {})[r["name"]] = r["n"]
        chances = {letter: {name: n / sum(own.values()) for name, n in own.items()} for letter, own in counts.items()}
        known.unpersist()
    final = rows.sparkSession.sparkContext.broadcast(chances or {})

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Alignments(batch.column("word"), batch.column("phones"), final.value).likeliest(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("phones"), pa.array(found, pa.list_(pa.string()))], ["word", "phones", "own"])

    return rows.mapInArrow(align, "word string, phones array<string>, own array<string>").where("own IS NOT NULL")


def _windows(words: DataFrame, *also: str) -> DataFrame:
    """``word, pos, key, window, offset`` of the letters of (word) rows, and other columns."""
    ahead = trees.reach(trees.SCOPE, GROUPS)
    at = words.select("word", *also, F.posexplode(F.regexp_extract_all("word", F.lit("(?s:.)"), F.lit(0))).alias("pos", "key"))
    start = F.greatest(F.col("pos") + 1 - trees.SCOPE, F.lit(0))
    marked = F.concat(F.lit("#"), F.col("word"), F.lit("_"))
    return at.select("word", *also, "pos", "key", F.substr(marked, start + 1, F.col("pos") + 2 + ahead - start).alias("window"), (F.col("pos") + 1 - start).alias("offset"))


def train_sounds(pron: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The sound trees of (word, phones) rows: from letters in context to their phones."""
    aligned = align_phones(pron, rounds).select("word", "own")
    each = _windows(aligned, "own").withColumn("cls", F.element_at("own", F.col("pos") + 1))
    examples = each.groupBy("key", "window", "offset", F.when(F.col("cls") == "", letters.EPSILON).otherwise(F.col("cls")).alias("cls")).agg(F.count("*").alias("n"))
    return trees.grow(examples, GROUPS)


def predict_phones(words: DataFrame, tree: DataFrame) -> DataFrame:
    """Distinct (word) rows with ``phones``: each letter's likeliest phones, blank for none and for letters without a tree."""
    asked = words.select(F.lower("word").alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    found = trees.predict(_windows(asked), tree)
    first = F.try_element_at("classes", F.lit(1))["cls"]
    own = found.select("word", "pos", F.coalesce(F.when(first == letters.EPSILON, "").otherwise(first), F.lit("")).alias("p"))
    return own.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("phones"))


def sound_words(words: DataFrame, lang: str, pron: DataFrame | None = None, tree: DataFrame | None = None, first: bool = False) -> DataFrame:
    """Distinct lower-case (word) rows with ``phones, exact, options, rank``: native words as the words sound, all of them or only the ``first``.

    A word of very many has several rows, as in ``distinct_sounds``.

    A word of the dictionary ``pron`` (word, phones) has its phones from there, the first of several; all others have them
    from the sound trees, or none without.
    """
    asked = words.select(F.lower("word").alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    said = asked.select("word", F.lit(None).cast("array<string>").alias("phones"), F.lit(False).alias("exact")).limit(0)
    left = asked
    if pron is not None:
        known = pron.groupBy(F.lower("word").alias("word")).agg(F.min("phones").alias("phones"))
        direct, left = lookup.exact_dict_first(asked, known)
        said = direct.select("word", "phones", F.lit(True).alias("exact"))
    if tree is not None:
        said = said.unionByName(predict_phones(left, tree).withColumn("exact", F.lit(False)))
    options = romanize.first_sounds(said, lang).withColumn("rank", F.lit(0).cast("long")) if first else romanize.distinct_sounds(said, lang)
    return said.join(options, "word").select("word", "phones", "exact", "options", "rank")
