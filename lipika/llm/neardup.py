"""MinHash near-dedup: b-bit signatures, band candidates, exact confirmation, connected components.

1. One pass makes each text's shingle set, and from it ``HASHES`` minima: their four lowest bits,
   packed as bit planes, and ``BANDS`` band keys of four whole minima each. Texts with equal sets
   are one class from here on.
2. A band bucket's members are first compared with its smallest member only. That joins most
   groups of copies without making their pairs.
3. Members of one bucket that are still in different components may be linked as well; nothing else
   can be left, for a link inside a component would change nothing. Each block of such a bucket
   estimates the similarity of its pairs by the packed bits, corrected for chance agreement of low
   bits, and passes a pair on if it is at most five standard deviations under the threshold. It
   emits a spanning forest of these pairs, so a block has fewer rows out than members.
4. The trees of all forests make clusters. Each cluster's full shingle sets meet in blocks of
   bounded size, where all its likely pairs are decided exactly; again only a forest of the links
   that join components leaves a block. At the threshold a link misses all bands with probability
   5e-6, above it less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize, materialize_at

SHINGLE = 5
THRESHOLD = 75
HASHES, ROWS, BANDS = 128, 4, 32
LOW_BITS = 4
#: Members of a bucket whose signatures are compared with as many others' at once.
BLOCK = 4_000
#: Members of a cluster, and shingles of all of them, that are compared with as many others at once.
CLUSTER_BLOCK, CLUSTER_SHINGLES = 2_000, 2_000_000
#: Links in one file of a round of components.
LINKS_A_FILE = 500_000
#: Members that one task compares with one document; larger stars are dealt to several.
STAR = 2_000

_rng = np.random.default_rng(12345)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2 ** 64
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _upto(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 17)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)


def words(text: str) -> list[bytes]:
    """A-Z lowered, cut at spaces and the control characters 9 to 13."""
    return text.encode().lower().split()


def shingle_hashes(own: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words, in order; of all words together where there are fewer."""
    if not own:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(own), np.uint8)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(width, len(own))
    starts, ends = starts[: len(own) - k + 1], ends[k - 1 :]
    _upto(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str) -> set[bytes]:
    """The exact set of shingles: runs of five words, or the whole sequence where there are fewer."""
    own = words(text)
    if len(own) < SHINGLE:
        return {b" ".join(own)} if own else set()
    return {b" ".join(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)}


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    wide = (1 << 17) // HASHES
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), wide):
            own = hashes[None, a : a + wide] * _A[:, None]
            own += _B[:, None]
            np.minimum(out, own.min(1) >> np.uint64(32), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: its number and its four whole minima."""
    with np.errstate(over="ignore"):
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for column in low.reshape(BANDS, ROWS).T:
            keys = _mix(keys ^ (column * np.uint64(0xD6E8FEB86659FD93)))
    return keys.view(np.int64)


def bit_planes(low: np.ndarray) -> np.ndarray:
    """The minima's low bits, plane by plane: bit j of plane p is bit p of minimum j."""
    bits = (low[None, :] >> np.arange(LOW_BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_key, planes, bands`` of (doc_id, text); the last three are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, planes, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(words(text or "")))
                sizes.append(len(own))
                if not len(own):
                    for column in (keys, planes, bands):
                        column.append(None)
                    continue
                low = minima(own)
                keys.append(hashlib.md5(own.tobytes()).digest())
                planes.append(bit_planes(low))
                bands.append(band_keys(low))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(planes, longs), pa.array(bands, longs)], ["doc_id", "n_shingles", "set_key", "planes", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, planes array<long>, bands array<long>")


#: Of ``HASHES`` minima, how many may differ in their low bits at a similarity of five standard deviations under the
#: threshold, less what chance makes agree.
MOST_APART = HASHES * (1 - 0.5**LOW_BITS) * (1 - THRESHOLD / 100) + 5 * (HASHES * (1 - 0.5**LOW_BITS) * (1 - THRESHOLD / 100) * (1 - (1 - 0.5**LOW_BITS) * (1 - THRESHOLD / 100))) ** 0.5


def likely(a: Column, b: Column) -> Column:
    """Whether packed low bits allow a link."""
    words_a_plane = HASHES // 64
    apart = F.lit(0)
    for w in range(words_a_plane):
        differ = None
        for p in range(LOW_BITS):
            x = a[p * words_a_plane + w].bitwiseXOR(b[p * words_a_plane + w])
            differ = x if differ is None else differ.bitwiseOR(x)
        apart = apart + F.bit_count(differ)
    return apart <= F.lit(MOST_APART)


def likely_to(planes: np.ndarray, i: int) -> np.ndarray:
    """As ``likely``, of member i and each member of a block; ``planes`` is (members, low bits, words)."""
    differ = np.bitwise_or.reduce(planes ^ planes[i], axis=1)
    return np.bitwise_count(differ).sum(1) <= MOST_APART


def in_blocks(members: DataFrame, key: str, blocks: Column, carry: list[str], compare) -> DataFrame:
    """(a, b) pairs that ``compare`` finds among the members (rep, ``key``, ...) of one key.

    A key is cut into ``blocks`` (an aggregate over its members), and each pair of its blocks is
    one bounded piece of work, so a large one is dealt to many tasks. ``compare`` gets a piece's
    columns ``carry`` as arrays or lists, and which of its members are its first and its second block's.
    """
    sizes = members.groupBy(key).agg(blocks.cast("int").alias("blocks"))
    # a hot key's members are split by adaptive execution, which a broadcast of the sizes would keep together
    dealt = members.join(sizes.hint("merge"), key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select(key, "block", *carry, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(key, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", *carry)
    dealt = dealt.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def done() -> pa.RecordBatch:
            piece = pa.Table.from_batches(held)
            block = piece.column("block").to_numpy()
            found = list(compare({c: piece.column(c).combine_chunks() for c in carry}, block == at[1], block == at[2]))
            columns = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (key, "p", "q")), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != at:
                    yield done()
                    held = []
                at = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _planes(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), LOW_BITS, HASHES // 64)


def likely_forest(members: DataFrame) -> DataFrame:
    """A spanning forest, block by block, of likely pairs of different components c among (band, rep, c, planes) rows."""

    def compare(piece, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        rep, comp = (piece[c].to_numpy() for c in ("rep", "c"))
        if (comp == comp[0]).all():
            return
        planes, tree = _planes(piece["planes"]), np.arange(len(rep))
        for i in np.flatnonzero(left):
            near = np.flatnonzero(likely_to(planes, i) & (comp != comp[i]) & right & (tree != tree[i]))
            if len(near):
                joined, first = np.unique(tree[near], return_index=True)
                for j in near[first]:
                    yield int(rep[i]), int(rep[j])
                tree[np.isin(tree, joined)] = tree[i]

    return in_blocks(members, "band", F.ceil(F.count("*") / BLOCK), ["rep", "c", "planes"], compare)


def link_forest(members: DataFrame) -> DataFrame:
    """Links that join different components c among (cluster, rep, c, planes, hashes, size) rows, decided on the full sets of hashed shingles."""

    def compare(piece, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        rep = piece["rep"].to_numpy()
        tree = np.unique(piece["c"].to_numpy(), return_inverse=True)[1]
        planes = _planes(piece["planes"])
        sets = [np.frombuffer(x, np.uint64) for x in piece["hashes"].to_pylist()]
        size = np.array([len(x) for x in sets])
        starts = np.cumsum(size) - size
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(known), bool)
        for i in np.flatnonzero(left):
            fits = (100 * np.minimum(size, size[i]) >= THRESHOLD * np.maximum(size, size[i])) & (tree != tree[i]) & right
            near = np.flatnonzero(likely_to(planes, i) & fits)
            if not len(near):
                continue
            own = flat[starts[i] : starts[i] + size[i]]
            mark[own] = True
            if 4 * len(near) > len(rep):
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[near]
            else:
                both = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j] + size[j]]]) for j in near])
            mark[own] = False
            near = near[100 * both >= THRESHOLD * (size[near] + size[i] - both)]
            joined, first = np.unique(tree[near], return_index=True)
            for j in near[first]:
                yield int(rep[i]), int(rep[j])
            tree[np.isin(tree, joined)] = tree[i]

    blocks = F.ceil(F.greatest(F.count("*") / CLUSTER_BLOCK, F.sum("size") / CLUSTER_SHINGLES))
    return in_blocks(members, "cluster", blocks, ["rep", "c", "planes", "hashes"], compare)


def hashed_sets(texts: DataFrame) -> DataFrame:
    """``rep, hashes, size``: the sets of hashed shingles of (doc_id, text) rows that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(words(t or ""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64())], ["rep", "hashes", "size"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, hashes binary, size long").where("size > 0")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) pairs whose full shingle sets reach the threshold.

    The texts of all b come to their a, whose own text goes ahead of them; an a with many b is
    dealt to several tasks, each with a copy of its text.
    """
    stars = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).alias("salt"))
    members = dealt.join(texts, dealt["b"] == texts["doc_id"]).select("a", "salt", "b", "text")
    heads = dealt.select("a", "salt").distinct()
    heads = heads.join(texts, heads["a"] == texts["doc_id"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    # not by name only: each (a, salt) is whole in one partition, its head first
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for batch in batches:
            found = []
            for a, salt, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, salt) != at:
                    at, own = (a, salt), []
                other = shingle_set(text or "")
                if b is None:
                    own.append(other)
                elif any(100 * (both := len(mine & other)) >= THRESHOLD * (len(mine) + len(other) - both) for mine in own if mine and other):
                    found.append((a, b))
            columns = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of (a, b) links.

    Large-star and small-star rounds: neighbours are only ever joined with a minimum, so no task
    gathers a node's links; each round is a table in the shared folder. It ends when every node
    points at one other that points at none, after a number of rounds that grows with the
    logarithm of the size.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    files = 1 + edges.count() // LINKS_A_FILE  # few links are not worth a file for each shuffle partition
    now, path = materialize_at(edges.where("a <> b").select(high.alias("v"), low.alias("m")).distinct().repartition(files), "links")
    while not _starred(now):
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("w")).select(F.col("u").alias("of"), F.least("u", "w").alias("to"))
        large = both.join(least, both["u"] == least["of"]).where("w > u").select(F.col("w").alias("v"), F.col("to").alias("m")).distinct()
        first = large.groupBy("v").agg(F.min("m").alias("to")).withColumnRenamed("v", "of")
        small = large.join(first, large["v"] == first["of"])
        # each v to its least neighbour, and its other neighbours to that
        moved = small.select(F.when(F.col("m") == F.col("to"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("to").alias("m")).distinct()
        after, fresh = materialize_at(moved.repartition(files), "links")
        drop_path(spark, path)
        now, path = after, fresh
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())


def _starred(links: DataFrame) -> bool:
    """Whether each v has one m, and no m is a v."""
    seen = links.select(F.col("v").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(links.select(F.col("m").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return seen.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Link (doc_id, text) rows whose shingle sets have a Jaccard similarity of 0.75 or more.

    Returns ``doc_id, n_shingles, component_id, kept`` for every row: the component's smallest
    doc_id and whether it is this row's. A null or empty text, and one without words, has no
    shingles and links with nothing. A text of fewer than five words is one shingle. Rows of one
    doc_id are one document: a link of either is a link of both. A row whose doc_id is null is
    kept, alone, with a null component. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = materialize_at(df, name)
        scratch.append(path)
        return out

    signed = materialize(signatures(docs), "signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = kept(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("planes").alias("planes"), F.first("bands").alias("bands")), "classes")
    # rows of one doc_id with different texts tie their classes
    same = usable.select("set_key", "doc_id").join(classes.select("set_key", "rep").hint("merge"), "set_key").where("doc_id <> rep").select("doc_id", "rep").distinct()
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    also_rep = same.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    many = same.join(twice.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    tied = also_rep.unionByName(many)

    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select("band", "lead")
    members = kept(banded.join(buckets.hint("merge"), "band"), "band-members")
    planes = classes.select("rep", "planes")
    texts = kept(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), "candidate-texts")

    x = planes.select(F.col("rep").alias("a"), F.col("planes").alias("x"))
    y = planes.select(F.col("rep").alias("b"), F.col("planes").alias("y"))
    led = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = kept(led.join(y, "b").join(x, "a").where(likely(F.col("x"), F.col("y"))).select("a", "b").distinct(), "star-pairs")
    links = kept(confirm(stars, texts).unionByName(tied), "star-links")
    found = components(links)

    placed = members.join(found, members["rep"] == found["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("c"))
    open_buckets = placed.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("band")
    loose = placed.join(open_buckets.hint("merge"), "band")
    trees = kept(likely_forest(loose.join(planes, "rep")), "likely-pairs")
    if not trees.isEmpty():
        clusters = components(trees).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        sets = hashed_sets(texts.join(clusters.select(F.col("rep").alias("doc_id")), "doc_id"))
        near = clusters.join(found, clusters["rep"] == found["node"], "left").select("cluster", "rep", F.coalesce("component", "rep").alias("c"))
        more = kept(link_forest(near.join(planes, "rep").join(sets, "rep")), "cluster-links")
        if not more.isEmpty():
            found = components(links.unionByName(more))

    of_class = classes.join(found, classes["rep"] == found["node"], "left").select("set_key", F.coalesce("component", "rep").alias("class_id"))
    of_class = materialize(of_class, "class-components")
    for path in scratch:
        drop_path(spark, path)
    rows = signed.select("doc_id", "n_shingles", "set_key")
    # rows without words have no class, and would all meet in one task
    worded = rows.where("set_key IS NOT NULL").join(of_class.hint("merge"), "set_key", "left").select("doc_id", "n_shingles", "class_id")
    rows = worded.unionByName(rows.where("set_key IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class_id")))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
