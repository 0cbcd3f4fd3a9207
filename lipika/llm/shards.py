"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups of one size are alike to the packing, so it works on how many groups there are of each
size: a table whose length does not grow with the number of groups, and the result is that of
packing every group by itself, the largest first. Which group goes where follows from its number
among those of its size.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Rows of a shard (or groups of a size) that are numbered by one task, about.
ROWS_A_STRIP = 50_000


class CapacityTree:
    """A balanced (randomised, fixed seed) search tree of bins by remaining capacity."""

    def __init__(self):
        self._root = None
        self._rank = random.Random(0)

    def add(self, key: tuple[int, int]) -> None:
        """Insert (remaining, bin)."""

        def put(node, key, rank):
            if node is None:
                return [key, rank, None, None]
            side = 2 if key < node[0] else 3
            node[side] = put(node[side], key, rank)
            child = node[side]
            if child[1] > node[1]:  # rotate up
                other = 5 - side
                node[side], child[other] = child[other], node
                return child
            return node

        self._root = put(self._root, key, self._rank.random())

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that still holds ``size``."""
        best, node = None, self._root
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            self._root = self._without(self._root, best)
        return best

    def _without(self, node, key):
        if node[0] == key:
            left, right = node[2], node[3]
            if left is None or right is None:
                return right if left is None else left
            side = 2 if left[1] > right[1] else 3
            child = node[side]
            other = 5 - side
            node[side], child[other] = child[other], node
            child[other] = self._without(node, key)
            return child
        side = 2 if key < node[0] else 3
        node[side] = self._without(node[side], key)
        return node


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[dict[int, list[tuple[int, int]]], int] | None:
    """Pack (size, number of groups of that size) classes: by size, (bin, groups) in order, and the number of bins.

    The next largest group enters the bin with the least remaining capacity that holds it. Groups of
    one size are alike, and a bin that has taken one is then the tightest for the next as long as
    it has room, so it takes as many at once as fit. A group larger than the capacity gets a bin of
    its own. None if more than ``most`` bins are needed.
    """
    tree, where, bins = CapacityTree(), {}, 0
    for size, left in sorted(classes, reverse=True):
        where[size] = []
        while left:
            found = tree.take(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
                if most is not None and bins > most:
                    return None
            room, home = found
            n = min(left, room // size) if size else left
            where[size].append((home, n))
            left -= n
            tree.add((room - n * size, home))
    return where, bins


def pack_into(classes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """(shard, groups) lists by size of (size, number of groups) classes: near equal shards, however large single groups are.

    A group that is larger than an even share of what is left has a shard of its own. The others go
    into the remaining shards by best-fit-decreasing, with the least capacity (to a hundredth of a
    percent) that needs no more of them, and are levelled.
    """
    rest, where, own = dict(sorted(((s, n) for s, n in classes if n), reverse=True)), {}, 0
    total = sum(s * n for s, n in rest.items())
    for size in list(rest):
        while rest[size] and size * (shards - own) > total:
            where.setdefault(size, []).append((own, 1))
            rest[size], total, own = rest[size] - 1, total - size, own + 1
        if rest[size]:
            break
    rest, shards = {s: n for s, n in rest.items() if n}, shards - own
    if not rest:
        return where
    low = -(-total // shards)
    step = max(1, low // 10_000)
    # the least is seldom far above an even share: steps that double, then halves
    reach, best = step, best_fit_decreasing(rest.items(), low, shards)
    high = low
    while best is None:
        low, high = high + 1, high + reach
        reach *= 2
        best = best_fit_decreasing(rest.items(), high, shards)
    while low + step <= high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest.items(), middle, shards)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    for size, homes in _level(best[0], shards).items():
        where.setdefault(size, []).extend((own + home, n) for home, n in homes)
    return where


def _level(where: dict[int, list[tuple[int, int]]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """Move groups from the fullest bin to the emptiest, while that brings the two nearer."""
    bins = [dict[int, int]() for _ in range(shards)]
    for size, homes in where.items():
        for home, n in homes:
            bins[home][size] = bins[home].get(size, 0) + n
    sizes = [sum(s * n for s, n in own.items()) for own in bins]
    while True:
        full, empty = sizes.index(max(sizes)), sizes.index(min(sizes))
        gap = sizes[full] - sizes[empty]
        fits = [s for s, n in bins[full].items() if n and 0 < s < gap]
        if not fits:
            break
        moved = min(fits, key=lambda s: (abs(gap - 2 * s), s))
        n = max(1, min(bins[full][moved], gap // (2 * moved)))
        bins[full][moved] -= n
        bins[empty][moved] = bins[empty].get(moved, 0) + n
        sizes[full] -= n * moved
        sizes[empty] += n * moved
    return {size: [(home, own[size]) for home, own in enumerate(bins) if own.get(size)] for size in where}


def size_class(size: Column) -> Column:
    """A size to 16 significant bits, rounded up: exact to 65,536 and to one in 32,768 above, so that there are at most
    65,536 + 32,768 * 47 different ones."""
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(size)) - 16, F.lit(0)))
    return (F.ceil(size / unit) * unit).cast("long")


def _placed(groups: DataFrame, place) -> DataFrame:
    """Add ``shard`` to (key, bytes) groups: ``place`` packs the counts of all sizes, and the groups of a size are dealt out in order of their keys."""
    sized = materialize(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    counts = sized.groupBy("class").agg(F.count("*").alias("n")).collect()
    homes = place([(r["class"], r["n"]) for r in counts])
    rows = []
    for size, own in homes.items():
        upto = np.cumsum([n for _, n in own]).tolist()
        rows.append((size, upto, [home for home, _ in own]))
    spark = groups.sparkSession
    table = spark.createDataFrame(rows, "of long, upto array<long>, homes array<int>")
    ranked = number_slots(sized, ["key"], sum(r["n"] for r in counts), "class")
    # one row for each size: bounded by the number of size classes
    found = ranked.join(F.broadcast(table), F.col("class") == F.col("of"))
    home = F.element_at("homes", F.size(F.filter("upto", lambda u: u <= F.col("slot"))) + 1)
    return found.select("key", home.alias("shard"))


def _with_shard(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` with the shard of their key, a null key's too; a former ``shard`` column is replaced, others pass through."""
    placed = placed.select(placed["key"].alias("of"), placed["shard"].alias("home"))
    # the rows of a hot key are split by adaptive execution
    joined = rows.join(placed.hint("merge"), rows["key"].eqNullSafe(placed["of"]))
    return joined.select(*[rows[c] for c in rows.columns if c != "shard"], placed["home"].alias("shard"))


def assign_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` to rows of (key, size, ...): rows of one key share a shard, shards' sizes are near equal.

    Sizes are summed by key before anything moves. A key that is larger than an even share of what
    is left has a shard of its own (it is indivisible); the other shards share the rest evenly. A null
    size counts as 0, and rows of a null key are one group.
    """
    groups = rows.groupBy("key").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    placed = _placed(groups, lambda classes: pack_into(classes, shards))
    return _with_shard(rows, placed)


def number_slots(rows: DataFrame, order: list[str], n_rows: int, by: str) -> DataFrame:
    """Add ``slot``, gapless from 0 within each value of ``by``, numbered strip by strip so that no task holds all of one."""
    rows = rows.drop("slot")
    strips = max(1, -(-n_rows // ROWS_A_STRIP))
    strip = F.pmod(F.xxhash64(*order), F.lit(strips)).cast("int")
    # the rows as they are stand in one column, so that none of their names can clash; rows without ``by`` are a value of their own
    held = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), F.struct(rows[by]).alias("by"), strip.alias("strip"))
    counts = held.groupBy("by", "strip").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("by").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("by", "strip", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("by", "strip").orderBy(*[F.col("row").getField(c) for c in order]))
    done = held.withColumn("place", place).join(base, ["by", "strip"])
    return done.select("row.*", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put (doc_id, text) rows into shards 0 to ``shards - 1`` of near equal bytes; equal texts stay together.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. A null text has no bytes
    (and is equal to the empty text); sizes are UTF-8 bytes plus 1; every row is placed, repeated
    ones too; slots go by (doc_id, checksum, size) within strips of a shard; an empty table gives no
    rows. Equal texts are known by a 256-bit digest. Texts stay where they are read: only digests,
    sizes and checksums move.
    """
    text = F.coalesce("text", F.lit(""))
    raw = F.encode(text, "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"))
    rows = materialize(rows, "shard-sizes")
    placed = assign_shards(rows.withColumnRenamed("digest", "key"), shards)
    done = number_slots(placed, ["doc_id", "text_crc32", "size"], rows.count(), "shard")
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def fixed_capacity_shards(rows: DataFrame, capacity: int) -> DataFrame:
    """Add ``shard`` to rows of (key, size, ...): groups of equal keys in as few shards of ``capacity`` as best-fit-decreasing finds.

    A group larger than the capacity has a shard of its own. Sizes count to 16 significant bits, rounded up.
    """
    groups = rows.groupBy("key").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    placed = _placed(groups, lambda classes: best_fit_decreasing(classes, capacity)[0])
    return _with_shard(rows, placed)
