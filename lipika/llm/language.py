"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

A language has a probability for each piece of the vocabulary. A word's probability is the sum, over
all ways to cut it into pieces, of the product of these; the forward algorithm gives it without
listing the ways. Pieces are learned by expectation rounds over the counted words of all learning
documents: each round sums, by language and piece, how often a piece is expected in the words' segmentations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize_at

ROUNDS = 2
#: Share of probability that is dealt out evenly over all pieces, so that each has some.
EVEN = 0.01
#: A model has one number for each piece and language, whatever the corpus; more languages than this are an error.
MOST_LANGUAGES = 1_000
UNKNOWN = "und"
#: Words that a task gathers before it counts or scores them.
CHUNK_WORDS = 2_000_000

_WORDS = re.compile(r"[^\W\d_]+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_BYTES = 0x110000
_BITS = 21
_START = "▁"
_CELLS = 200_000


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def learning_fold(doc_id: Column) -> Column:
    """Documents to learn from: those whose checksum leaves a remainder by five. A null id isn't one, nor is it held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


class _Places(dict):
    """Words to places in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    found = _WORDS.findall(text.lower()) if text else []
    if not "".join(found).isalpha():  # some signs count as parts of words but are no letters
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return found


class Pieces:
    """The vocabulary as a trie in sorted arrays. A character that is no piece is read as its bytes, which are."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        steps: dict[int, int] = {}
        ends = [-1]
        self.longest = 1
        for piece in range(self.size):
            if model.is_control(piece) or model.is_unknown(piece):
                continue
            text = model.id_to_piece(piece)
            byte = _BYTE.fullmatch(text)
            symbols = [_BYTES + int(byte[1], 16)] if byte else list(map(ord, text))
            at = 0
            for s in symbols:
                at = steps.setdefault(at << _BITS | s, len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = piece
            self.longest = max(self.longest, len(symbols))
        self.keys = np.array(sorted(steps), np.int64)
        self.then = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)
        self.inner = np.zeros(len(ends), bool)  # nodes that a longer piece goes on from
        self.inner[self.keys >> _BITS] = True
        # the first step of every walk, by symbol; the others are searched for
        self.first = np.full(_BYTES + 256, -1, np.int64)
        roots = self.keys < 1 << _BITS
        self.first[self.keys[roots]] = self.then[roots]
        self.single = np.zeros(len(self.first), bool)
        self.single[self.keys[roots]] = self.ends[self.then[roots]] >= 0

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words, each with the mark of a word's start, as one array of symbols, and where each begins and how long it is."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer((_START + _START.join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        unknown = np.flatnonzero(~self.single[flat])
        parts, end = [flat], len(flat)
        for k in np.unique(np.searchsorted(starts, unknown, side="right") - 1).tolist():  # written anew, behind the others
            own = flat[starts[k] : starts[k] + lengths[k]].tolist()
            coded = [s for c in own for s in ([c] if self.single[c] else [_BYTES + b for b in chr(c).encode("utf-8", "surrogatepass")])]
            parts.append(np.array(coded, np.int64))
            starts[k], lengths[k] = end, len(coded)
            end += len(coded)
        return np.concatenate(parts), starts, lengths

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list]]:
        """Words of one length together: their places in the list, the length, and for each piece length its
        (bounds by start, word, start, piece), ordered by start."""
        if not words:
            return
        flat, starts, lengths = self.symbols(words)
        order = np.argsort(lengths, kind="stable")
        edge = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, edge):
            m = int(lengths[same[0]])
            for at in range(0, len(same), max(1, _CELLS // m)):
                some = same[at : at + max(1, _CELLS // m)]
                yield some, m, self._edges(flat[starts[some] + np.arange(m)[:, None]], m, len(some))

    def _edges(self, chars: np.ndarray, m: int, width: int) -> list:
        start, word = np.divmod(np.arange(m * width), width)
        state, out = self.first[chars.ravel()], []
        for length in range(1, min(m, self.longest) + 1):
            if length > 1:
                inside = start + length <= m
                start, word, state = start[inside], word[inside], state[inside]
                key = state << _BITS | chars[start + length - 1, word]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                state = np.where(self.keys[at] == key, self.then[at], -1)
            hit = state >= 0
            start, word, state = start[hit], word[hit], state[hit]
            piece = self.ends[state]
            ends = piece >= 0
            out.append((np.searchsorted(start[ends], np.arange(m + 1)), word[ends], start[ends], piece[ends]))
            go_on = self.inner[state]
            start, word, state = start[go_on], word[go_on], state[go_on]
        return out

    def sums(self, edges: list, m: int, p: list[np.ndarray], width: tuple, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Summed products of all segmentations up to each position (from it on, if ``back``), and the logarithm that each is scaled by.

        ``p`` has the probabilities of the edges of each piece length.
        """
        total, scale = np.zeros((m + 1, *width)), np.zeros((m + 1, *width))
        total[m if back else 0] = 1.0
        for step in range(1, m + 1):
            to = m - step if back else step
            scale[to] = scale[to + 1] if back else scale[to - 1]
            for k, (bounds, word, _, _) in enumerate(edges):
                length = k + 1
                if length > step:
                    break
                start = to if back else to - length
                low, high = bounds[start], bounds[start + 1] if start < m else len(word)
                if low < high:
                    rows = word[low:high]
                    total[to][rows] += total[to + length if back else to - length][rows] * p[k][low:high]
            if step % self.longest == 0:  # all that later steps look back to is scaled alike
                near = slice(to, to + self.longest) if back else slice(to - self.longest + 1, to + 1)
                by = total[to].copy()
                total[near] /= by
                scale[near] += np.log(by)
        return total, scale

    def log_chances(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Logarithms of the words' probabilities under each column of ``p``."""
        out = np.empty((len(words), p.shape[1]))
        for some, m, edges in self.groups(words):
            total, scale = self.sums(edges, m, [p[piece] for _, _, _, piece in edges], (len(some), p.shape[1]))
            out[some] = np.log(total[m]) + scale[m]
        return out

    def expected(self, words: list[str], langs: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words' segmentations, by language: a row for each piece."""
        out = np.zeros(p.shape[0] * p.shape[1])
        for some, m, edges in self.groups(words):
            lang, weight = langs[some], n[some]
            own = [p[piece, lang[word]] for _, word, _, piece in edges]
            ahead, up = self.sums(edges, m, own, (len(some),))
            behind, down = self.sums(edges, m, own, (len(some),), back=True)
            for k, (_, word, start, piece) in enumerate(edges):
                logs = up[start, word] + down[start + k + 1, word] - up[m, word]
                share = ahead[start, word] * own[k] * behind[start + k + 1, word] / ahead[m, word] * np.exp(logs)
                out += np.bincount(piece * p.shape[1] + lang[word], share * weight[word], len(out))
        return out.reshape(p.shape)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's vocabulary, loaded once."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


@dataclass(frozen=True)
class LanguageModel:
    """``chances`` has a row for each piece and a column for each of ``langs``, which are in order."""

    path: str
    langs: tuple[str, ...]
    chances: np.ndarray


def count_words(docs: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(text, lang) rows to ``lang, word, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        n = 0

        def close() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found = words_of(text)
                held.setdefault(lang, Counter()).update(found)
                n += len(found)
                if n >= chunk_words:
                    yield from close()
                    n = 0
        yield from close()

    return docs.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_language(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from (text, lang) rows; rows without a language or a letter teach nothing."""
    path = path or piece_path()
    spark: SparkSession = docs.sparkSession
    words, at = materialize_at(count_words(docs.where("lang IS NOT NULL AND text IS NOT NULL")), "language-words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = {lang: k for k, lang in enumerate(langs)}
    size = pieces(path).size
    chances = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds if langs else 0):
        known = spark.sparkContext.broadcast(chances)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                got = pieces(path).expected(batch.column("word").to_pylist(), lang, batch.column("n").to_numpy().astype(float), known.value)
                total = got if total is None else total + got
            if total is not None:
                piece, lang = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        # at most a number for each piece and language comes back
        sums = words.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(chances)
        counts[sums["piece"], sums["lang"]] = sums["n"]
        chances = (1 - EVEN) * counts / counts.sum(axis=0) + EVEN / size
        known.unpersist()
    drop_path(spark, at)
    return LanguageModel(path, tuple(langs), chances)


def identify_language(docs: DataFrame, model: LanguageModel, chunk_words: int = CHUNK_WORDS // 2) -> DataFrame:
    """(doc_id, text, ...) rows with ``lang_pred`` and ``score`` (the language's probability among those learned, all
    equally likely beforehand).

    Texts are whole. A text that is null or has no letter, or a model of no language, gives ``und`` with
    score 0; of equally likely languages the first is taken; the other columns pass through, but for
    these two, which are replaced; repeated rows stay, an empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, k = batch.column("text"), 0
            while k < batch.num_rows:  # as many texts at a time as have about so many words
                at, ids, ends, first = _Places(), [], [0], k
                while k < batch.num_rows and ends[-1] < chunk_words:
                    found = words_of(texts[k].as_py())
                    ids.append(np.fromiter(map(at.__getitem__, found), np.int64, len(found)))
                    ends.append(ends[-1] + len(found))
                    k += 1
                langs, n = shared.value.langs, k - first
                best, score = np.full(n, -1), np.zeros(n)
                spoken = np.flatnonzero(np.diff(ends)) if langs else np.array([], np.int64)
                if len(spoken):
                    logs = pieces(shared.value.path).log_chances(list(at), shared.value.chances)
                    for i in spoken:
                        own = logs[ids[i]].sum(axis=0)
                        best[i] = int(own.argmax())
                        score[i] = 1.0 / np.exp(own - own.max()).sum()
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([langs[b] if b >= 0 else UNKNOWN for b in best], pa.string()), pa.array(np.round(score, 9))], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema + ", lang_pred string, score double")
