"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted confirmation.

A document holds a benchmark item if some window of as many words as the item has a weighted
Jaccard similarity of 0.75 or more to it: over their five-word shingles (a text of fewer words is
one shingle), each weighted by how often it stands in the window.

1. A window and an item of the same number of words weigh the same, so to reach 0.75 they must
   share 6 of 7 shingles. Windows of which not even half stand in items of their size can't be
   near one, and are not fingerprinted; that leaves out nearly all of a clean corpus.
2. Such a window gets a 256-bit SimHash. Items are listed by each of the ``BLOCKS`` 16-bit blocks
   of their own SimHash, size by size. Fingerprints within ``RADIUS`` of each other have a block
   within ``RADIUS // BLOCKS`` bits (the pigeonhole principle), so the lists of a block's values
   that near find them all; a look-up reads those lists and no others.
3. Candidates within the radius are compared exactly.

At similarity 0.75 about 44 of 256 bits differ, with a deviation of 6, so the radius of 63 is three
deviations off. The items are a stated query set: they are taken in batches of bounded size, one
after another, and each batch is held against all documents in one pass over them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as batch_type

from .common import materialize_at
from .neardup import SHINGLE, _mix, shingle_hashes, words

THRESHOLD = 0.75
#: Bits of a fingerprint, its blocks, and the bits by which fingerprints may differ.
BITS, BLOCKS, RADIUS = 256, 16, 63
#: The share of a window's shingles that must stand in items of its size for it to be fingerprinted.
LEAST_KNOWN = 0.5
#: Characters of benchmark text that are held in memory at once; an item of more is a batch of its own.
BATCH_CHARS = 20_000_000
#: All ways to change at most ``RADIUS // BLOCKS`` bits of a block.
_NEAR = np.array([v for v in range(1 << 16) if v.bit_count() <= RADIUS // BLOCKS], np.int64)


def simhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """256 bits as 16 blocks: of each bit, whether the weighted shingles that have it outweigh those that don't."""
    with np.errstate(over="ignore"):
        wide = np.stack([_mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * k & 2**64 - 1)) for k in range(1, BITS // 64 + 1)], 1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1)
    return np.packbits(counts @ bits.astype(np.int64) * 2 > counts.sum()).view("<u2")


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: the sum of lesser weights by the sum of greater ones."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class ItemIndex:
    """One batch of benchmark items, by shingle and by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.weights, prints = [], [], [], []
        for item, text in items:
            own = words(text or "")
            if own:
                hashes, counts = np.unique(shingle_hashes(own), return_counts=True)
                self.ids.append(item)
                self.words.append(len(own))
                self.weights.append(Counter(dict(zip(hashes.tolist(), counts.tolist(), strict=True))))
                prints.append(simhash(hashes, counts))
        self.prints = np.array(prints, np.uint16).reshape(len(prints), BLOCKS)
        sizes = np.array(self.words, np.int64)
        # shingles of items by their width: of five words, or of a short item's own length
        self.widths: dict[int, np.ndarray] = {}
        for width in sorted({min(SHINGLE, n) for n in self.words}):
            known = [k for w, n in zip(self.weights, self.words, strict=True) if min(SHINGLE, n) == width for k in w]
            self.widths[width] = np.unique(np.array(known, np.uint64))
        self._bits = {}
        for width, known in self.widths.items():
            self._bits[width] = np.zeros(1 << 20, bool)
            self._bits[width][(known >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = {width: sorted({n for n in self.words if min(SHINGLE, n) == width}) for width in self.widths}
        self._of_size_keys = {n: np.unique(np.array([k for w, m in zip(self.weights, self.words, strict=True) if m == n for k in w], np.uint64)) for n in set(self.words)}
        self.of_size = {n: np.flatnonzero(sizes == n) for n in set(self.words)}
        # by size and block: the items in order of the block's value, and where each value's list begins
        self._lists = {}
        for n, own in self.of_size.items():
            for k in range(BLOCKS):
                order = own[np.argsort(self.prints[own, k], kind="stable")]
                self._lists[n, k] = order, self.prints[order, k].astype(np.int64)

    def _in_any(self, width: int, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of some item: a bit table first, then a search for those that it lets through."""
        maybe = np.flatnonzero(self._bits[width][(hashes >> np.uint64(44)).astype(np.int64)])
        out = np.zeros(len(hashes), bool)
        if len(maybe):
            known = self.widths[width]
            out[maybe] = known[np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)] == hashes[maybe]
        return out

    def touched(self, fingerprint: np.ndarray, size: int) -> np.ndarray:
        """Items of a size in the lists of all block values near the fingerprint's."""
        found = []
        for k in range(BLOCKS):
            items, values = self._lists[size, k]
            near = np.sort(int(fingerprint[k]) ^ _NEAR)
            if len(values) < len(near):  # fewer values have lists than are near
                at = np.minimum(np.searchsorted(near, values), len(near) - 1)
                found.append(items[near[at] == values])
            else:
                starts, ends = np.searchsorted(values, near), np.searchsorted(values, near, "right")
                full = np.flatnonzero(ends > starts)
                found += [items[a:b] for a, b in zip(starts[full], ends[full], strict=True)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def within(self, fingerprint: np.ndarray, size: int) -> np.ndarray:
        """Items of a size whose fingerprint is within the radius, found by blocks."""
        found = self.touched(fingerprint, size)
        return found[np.bitwise_count(self.prints[found] ^ fingerprint).sum(1, dtype=np.int64) <= RADIUS]

    def matches(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of every item that the text holds."""
        own = words(text)
        best: dict[int, tuple[float, int]] = {}
        for width, known in self.widths.items():
            if len(own) < width:
                continue
            hashes = shingle_hashes(own, width)
            if len(own) < SHINGLE and width < len(own):
                hashes = np.array([shingle_hashes(own[i : i + width], width)[0] for i in range(len(own) - width + 1)], np.uint64)
            in_any = self._in_any(width, hashes)
            if not in_any.any():
                continue
            places = np.flatnonzero(in_any)
            for size in self.sizes[width]:
                mine = places[np.isin(hashes[places], self._of_size_keys[size])]
                if len(mine) < LEAST_KNOWN * (size - width + 1):
                    continue
                hit = np.zeros(len(hashes) + 1, np.int64)
                hit[mine + 1] = 1
                hit = np.cumsum(hit)
                span = size - width + 1  # shingles of a window
                last = len(hashes) - span
                if last < 0:
                    continue
                shared = hit[span : span + last + 1] - hit[: last + 1]
                for start in np.flatnonzero(shared >= LEAST_KNOWN * span):
                    window, counts = np.unique(hashes[start : start + span], return_counts=True)
                    candidates = self.within(simhash(window, counts), size)
                    if len(candidates):
                        weights = Counter(dict(zip(window.tolist(), counts.tolist(), strict=True)))
                        for item in candidates:
                            found = weighted_similarity(weights, self.weights[item])
                            if found >= THRESHOLD and found > best.get(item, (0.0, 0))[0]:
                                best[item] = (found, int(start))
        return [(self.ids[i], s, at, self.words[i]) for i, (s, at) in sorted(best.items())]


def _batches(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of at most about ``BATCH_CHARS`` characters."""
    total = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // BATCH_CHARS)
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words`` of each benchmark item that each (doc_id, text) row holds.

    The best window is given, the first of equals. Null and empty texts hold nothing and are held
    by nothing; rows of one item_id are items of their own, and repeated documents are found each;
    an empty table on either side gives no rows; other columns are ignored. Each batch's matches
    are written to the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])

    def search(part: list[tuple]) -> DataFrame:
        index = ItemIndex(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, *m) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in index.matches(text)]
                columns = zip(*rows, strict=True) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)

        types = [batch_type(schema["doc_id"].dataType), batch_type(schema["item_id"].dataType), pa.float64(), pa.int64(), pa.int64()]
        return docs.mapInArrow(run, schema)

    found = []
    for part in _batches(items):
        # written before the next batch is read, so that the driver holds one index at a time
        found.append(materialize_at(search([tuple(r) for r in part.orderBy("item_id", "text").collect()]), "matches")[0])
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
