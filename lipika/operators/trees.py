"""Decision trees over letters in context, grown for all letters at once.

An example is (key, window, offset, cls, n): a letter's surroundings, marked ``#`` where the word
begins and ``_`` where it ends, the letter's place in them, its class, and how often it was seen.
A split asks whether the text at some distance from the letter begins with one of a feature's
literals; matches go left. A node is named by the way to it: ``0`` for each left, ``1`` for each
right turn from the root, whose name is empty; so no depth is too great for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

SCOPE = 4
#: The order in which distances are tried; the first of equal splits wins.
DISTANCES = [0, *[d for k in range(1, SCOPE + 1) for d in (-k, k)]]
#: Memory of a node that one task finishes; larger nodes are split by all tasks together.
NODE_BYTES = 1_500_000_000
#: More than an example takes in such a task beside its characters: its row, and numbers for each place of its surroundings.
EXAMPLE_BYTES = 900
#: Counts of beginnings by class that such a task holds at once.
CELLS = 2_000_000
#: Examples that a task counts at once while all tasks split a node together.
CHUNK = 250_000
#: Nodes of a model that is sent to all tasks; a larger one is joined level by level.
MODEL_NODES = 500_000

Groups = list[tuple[str, list[str]]]
LEAF = "array<struct<cls:string,n:bigint>>"
_NODE_TYPES = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("cls", pa.string()), ("n", pa.int64())]))]
TREE = f"key string, node string, delta int, feature string, literals array<string>, classes {LEAF}"


def reach(scope: int, groups: Groups) -> int:
    """Letters after a letter that its features can read."""
    return scope + max((len(x) for _, literals in groups for x in literals), default=1) - 1


def leaf_distribution(examples: DataFrame) -> DataFrame:
    """``node, classes``: class counts of each (key, node), the largest first, ties by class."""
    counts = examples.groupBy("key", "node", "cls").agg(F.sum("n").alias("n"))
    packed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("cls").alias("cls"))))
    return counts.groupBy("key", "node").agg(F.transform(packed, lambda x: F.struct(x["cls"].alias("cls"), (-x["m"]).alias("n"))).alias("classes"))


def node_purity(examples: DataFrame) -> DataFrame:
    """``key, node, purity, total``: the sum of squared class shares."""
    counts = examples.groupBy("key", "node", "cls").agg(F.sum("n").alias("n"))
    return counts.groupBy("key", "node").agg((F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("purity"), F.sum("n").alias("total"))


_SPLIT = ["key", "node", "delta", "delta_rank", "feature", "rank"]


def split_counts(examples: DataFrame, groups: Groups) -> DataFrame:
    """``key, node, delta, delta_rank, feature, rank, cls, l``: the examples of a class that go left at a split.

    A place's text meets features by each of its beginnings, as many as the longest literal has letters.
    """
    asked: dict[str, list] = {}
    for rank, (label, literals) in enumerate(groups):  # a rule table
        for literal in dict.fromkeys(x for x in literals if x):
            asked.setdefault(literal, []).append(F.struct(F.lit(label).alias("feature"), F.lit(rank).alias("rank")))
    longest = max(map(len, asked), default=1)
    known = F.create_map(*[x for literal, own in asked.items() for x in (F.lit(literal), F.array(*own))]) if asked else F.lit(None).cast("map<string,array<struct<feature:string,rank:int>>>")
    deltas = F.explode(F.array(*[F.struct(F.lit(d).alias("delta"), F.lit(k).alias("delta_rank")) for k, d in enumerate(DISTANCES)]))
    start = F.col("offset") + F.col("d.delta")  # from 0
    at = examples.select("key", "node", "window", "offset", "cls", "n", deltas.alias("d")).withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") < F.char_length("window")))
    heads = at.select("key", "node", "cls", "n", "d.delta", "d.delta_rank", F.substr("window", F.col("start") + 1, F.lit(longest)).alias("head"))
    grouped = heads.groupBy("key", "node", "cls", "delta", "delta_rank", "head").agg(F.sum("n").alias("n"))
    begins = F.transform(F.sequence(F.lit(1), F.char_length("head")), lambda k: F.substr("head", F.lit(1), k))
    # several literals of a feature may match: an example counts once
    met = F.array_distinct(F.flatten(F.filter(F.transform(begins, lambda x: F.try_element_at(known, x)), lambda fs: fs.isNotNull())))
    hit = grouped.select("key", "node", "cls", "delta", "delta_rank", "n", F.explode(met).alias("f")).select("key", "node", "cls", "delta", "delta_rank", "n", "f.feature", "f.rank")
    return hit.groupBy(*_SPLIT, "cls").agg(F.sum("n").alias("l"))


def sibling_counts(parents: DataFrame, counted: DataFrame, pairs: DataFrame) -> DataFrame:
    """The split counts of the larger child of each parent: the parent's less the smaller child's.

    ``pairs``: ``key, parent, smaller, larger``, the children of each parent by name.
    """
    own = [*_SPLIT[2:], "cls"]
    of_parents = parents.withColumnRenamed("node", "parent").join(pairs, ["key", "parent"]).select("key", F.col("larger").alias("node"), *own, "l")
    of_smaller = counted.withColumnRenamed("node", "smaller").join(pairs, ["key", "smaller"]).select("key", F.col("larger").alias("node"), *own, (-F.col("l")).alias("l"))
    return of_parents.unionByName(of_smaller).groupBy(*_SPLIT, "cls").agg(F.sum("l").alias("l")).where("l > 0")


def scores_of(counts: DataFrame, examples: DataFrame) -> DataFrame:
    """``key, node, delta, delta_rank, feature, rank, score``: the purity after each split that parts a node; what does not go left goes right."""
    whole = examples.groupBy("key", "node", "cls").agg(F.sum("n").cast("double").alias("t"))
    sums = whole.groupBy("key", "node").agg(F.sum("t").alias("total"), F.sum(F.col("t") * F.col("t")).alias("squares"))
    scored = counts.withColumn("l", F.col("l").cast("double")).join(whole, ["key", "node", "cls"]).groupBy(*_SPLIT).agg(
        F.sum("l").alias("nl"), F.sum(F.col("l") * F.col("l")).alias("sl"), F.sum((F.col("t") - F.col("l")) * (F.col("t") - F.col("l")) - F.col("t") * F.col("t")).alias("dr")
    )
    joined = scored.join(sums, ["key", "node"]).where("nl < total")
    right = F.col("total") - F.col("nl")
    score = (F.try_divide("sl", "nl") + F.try_divide(F.col("squares") + F.col("dr"), right)) / F.col("total")
    return joined.select(*_SPLIT, F.round(score, 12).alias("score"))


def split_scores(examples: DataFrame, groups: Groups) -> DataFrame:
    """The scores of all splits of nodes whose examples are counted here."""
    return scores_of(split_counts(examples, groups), examples)


def best_split(scores: DataFrame, purity: DataFrame) -> DataFrame:
    """The best split of each node that betters its purity; ties go to the first distance, then the first feature."""
    order = Window.partitionBy("key", "node").orderBy(F.desc("score"), "delta_rank", "rank")
    better = scores.join(purity, ["key", "node"]).where(F.col("score") > F.round("purity", 12))
    return better.withColumn("place", F.row_number().over(order)).where("place = 1").select("key", "node", "delta", "feature", "rank", "score")


def matches(window: Column, offset: Column, delta: Column, literals: Column) -> Column:
    start = offset + delta
    inside = (start >= 0) & (start < F.char_length(window))
    return inside & F.exists(literals, lambda lit: F.substr(window, F.greatest(start, F.lit(0)) + 1, F.char_length(lit)) == lit)


def _child(node: Column, left: Column) -> Column:
    return F.concat(node, F.when(left, "0").otherwise("1"))


class _Subtree:
    """The tree below a node whose examples one task holds.

    What a place's text begins with decides every feature there, so examples are counted by
    (distance, beginning, class) and the counts are added up by feature.
    """

    def __init__(self, windows: list[str], offsets: list[int], groups: Groups):
        self.groups = groups
        longest = _longest(groups)
        known: dict[str, int] = {}
        self.codes = np.full((len(windows), len(DISTANCES)), -1, np.int64)
        for i, (window, offset) in enumerate(zip(windows, offsets, strict=True)):
            for j, d in enumerate(DISTANCES):
                at = offset + d
                if 0 <= at < len(window):
                    self.codes[i, j] = known.setdefault(window[at : at + longest], len(known))
        self.holds = _holds(list(known), groups)
        self.codes = np.where(self.codes < 0, -1, self.codes + len(known) * np.arange(len(DISTANCES)))

    @classmethod
    def placed(cls, table: pa.Table, groups: Groups) -> _Subtree:
        """The same from rows as ``_placed`` makes them; beginnings that meet the same features are one, and one that meets none stands outside."""
        self, longest = cls.__new__(cls), _longest(groups)
        self.groups, width = groups, 2 * SCOPE + longest
        text = "".join(map(_text, table.column("placed").chunks))
        letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, width)
        chars = np.unique(letters)
        lo, hi = (table.column(c).to_numpy()[:, None] for c in ("lo", "hi"))
        at = np.arange(width)
        numbered = np.zeros(int(chars[-1]) + 1 if len(chars) else 1, np.int32)
        numbered[chars] = np.arange(1, len(chars) + 1)
        letters = np.where((at >= lo) & (at < hi), numbered[letters], np.int32(0))
        heads = np.zeros((len(letters), len(DISTANCES)), np.int32)
        names = [""]  # of codes: a beginning ends where the window ends
        for k in range(longest):
            pairs = heads * (len(chars) + 1) + letters[:, [SCOPE + d + k for d in DISTANCES]]
            code = np.zeros(len(names) * (len(chars) + 1), np.int32)  # as many as the beginnings there can be, each a letter longer than one that occurs
            code[pairs] = 1
            seen = np.flatnonzero(code)
            code[seen] = np.arange(len(seen))
            heads = code[pairs]
            pairs_seen = [divmod(x, len(chars) + 1) for x in seen.tolist()]
            names = [names[x] + chr(chars[c - 1]) if c and (names[x] or k == 0) else names[x] for x, c in pairs_seen]
        self.holds, merged = np.unique(_holds(names, groups), axis=0, return_inverse=True)
        self.codes = merged.reshape(-1).astype(np.int32)[heads] + len(self.holds) * np.arange(len(DISTANCES), dtype=np.int32)
        return self

    def without_copies(self) -> _Subtree:
        """Of features that hold alike here the first is kept, for it wins; those that never hold go."""
        _, first = np.unique(self.holds, axis=1, return_index=True)
        kept = [int(k) for k in np.sort(first) if self.holds[:, k].any()]
        self.groups, self.holds = [self.groups[k] for k in kept], np.ascontiguousarray(self.holds[:, kept])
        return self

    def _left(self, rows: np.ndarray, classes: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
        """Counts by (distance, feature) and class of the examples that match."""
        heads, step = len(self.holds), max(1, CELLS // kinds)
        cells = heads * len(DISTANCES)
        if cells <= step and (cells <= len(DISTANCES) * len(rows) or cells * kinds <= 10_000):  # a cell for each beginning at each distance: no sorting
            counts = np.zeros(cells * kinds + 1)
            for a in range(0, len(rows), 50_000):
                codes, own = self.codes[rows[a : a + 50_000]], classes[a : a + 50_000, None]
                at = np.where(codes < 0, cells * kinds, codes.astype(np.int64) * kinds + own)
                counts += np.bincount(at.ravel(), np.repeat(n[a : a + 50_000], len(DISTANCES)), cells * kinds + 1)
            return (self.holds.T @ counts[:-1].reshape(len(DISTANCES), heads, kinds)).reshape(-1, kinds)
        codes = self.codes[rows].ravel()
        inside = np.flatnonzero(codes >= 0)
        of = inside // len(DISTANCES)
        seen, inverse = np.unique(codes[inside], return_inverse=True)
        cuts = np.searchsorted(seen, heads * np.arange(len(DISTANCES) + 1)).tolist()
        if len(seen) > step:  # the counts are made block by block of beginnings
            order = inverse.argsort(kind="stable")
            inverse, of = inverse[order], of[order]
        out = np.zeros((len(DISTANCES), len(self.groups), kinds))
        for a in range(0, len(seen), step):
            b = min(a + step, len(seen))
            own = slice(*np.searchsorted(inverse, [a, b])) if len(seen) > step else slice(None)
            counts = np.bincount((inverse[own] - a) * kinds + classes[of[own]], n[of[own]], (b - a) * kinds).reshape(-1, kinds)
            for j in range(len(DISTANCES)):
                x, y = max(cuts[j], a), min(cuts[j + 1], b)
                if x < y:
                    out[j] += self.holds[seen[x:y] - heads * j].T @ counts[x - a : y - a]
        return out.reshape(-1, kinds)

    def side(self, rows: np.ndarray, j: int, k: int) -> np.ndarray:
        """Which examples go left where feature ``k`` is asked at the distance of that place."""
        codes = self.codes[rows, j]
        return (codes >= 0) & (self.holds[np.maximum(codes - len(self.holds) * j, 0), k] == 1)

    def grow(self, classes: np.ndarray, n: np.ndarray, names: list[str], root: str) -> Iterator[tuple]:
        """(node, delta, feature, literals, classes) of the tree below ``root``, by the same rules as the levels."""
        waiting, place = [(root, np.arange(len(n)))], np.zeros(len(names), np.int64)
        while waiting:
            node, rows = waiting.pop()
            own = classes[rows]
            if len(names) <= 1000:
                of = np.flatnonzero(np.bincount(own))
                place[of] = np.arange(len(of))
                own = place[own]
            else:
                of, own = np.unique(own, return_inverse=True)
            whole = np.bincount(own, n[rows])
            best = _best(self._left(rows, own, n[rows], len(of)), whole) if len(of) > 1 else None
            if best is not None:
                # the splits stand in the order of distances and features, so the first of the best wins
                j, k = divmod(best, len(self.groups))
                yield node, DISTANCES[j], self.groups[k][0], self.groups[k][1], None
                side = self.side(rows, j, k)
                waiting += [(node + "1", rows[~side]), (node + "0", rows[side])]
                continue
            yield node, None, None, None, _ordered([names[i] for i in of], whole)


def _longest(groups: Groups) -> int:
    return max((len(x) for _, literals in groups for x in literals), default=1)


def _holds(heads: list[str], groups: Groups) -> np.ndarray:
    """1 where a beginning meets a feature."""
    of: dict[str, list[int]] = {}
    for k, (_, literals) in enumerate(groups):
        for x in literals:
            of.setdefault(x, []).append(k)
    holds = np.zeros((len(heads), len(groups)))
    for code, head in enumerate(heads):
        for n in range(1, len(head) + 1):
            holds[code, of.get(head[:n], [])] = 1
    return holds


def _best(left: np.ndarray, whole: np.ndarray) -> int | None:
    """The first of the best splits that better the purity of a node, of counts by split and class; None if there is none."""
    total, nl = whole.sum(), left.sum(1)
    parts = np.flatnonzero((nl > 0) & (nl < total))
    if not len(parts):
        return None
    left, nl = left[parts], nl[parts]
    right = whole - left
    score = np.round(((left * left).sum(1) / nl + (right * right).sum(1) / (total - nl)) / total, 12)
    return int(parts[score.argmax()]) if score.max() > round(float((whole * whole).sum() / (total * total)), 12) else None


def _ordered(names: list[str], whole: np.ndarray) -> list[dict]:
    return [{"cls": names[i], "n": int(whole[i])} for i in sorted(range(len(names)), key=lambda i: (-whole[i], names[i]))]


def _text(strings: pa.Array) -> str:
    """All strings of an array in one, read from its buffer."""
    if not len(strings):
        return ""
    ends = np.frombuffer(strings.buffers()[1], np.int32)
    return strings.buffers()[2][int(ends[strings.offset]) : int(ends[strings.offset + len(strings)])].to_pybytes().decode()


def _placed(examples: DataFrame, groups: Groups) -> DataFrame:
    """``key, placed, lo, hi, cls, n``: what features can read around a letter, the letter always in the same place; the window is from ``lo`` to before ``hi``."""
    width = 2 * SCOPE + _longest(groups)
    ahead = F.greatest(SCOPE - F.col("offset"), F.lit(0))
    cutout = F.substr("window", F.greatest(F.col("offset") - SCOPE, F.lit(0)) + 1, F.lit(width))
    hi = F.least(SCOPE - F.col("offset") + F.char_length("window"), F.lit(width))
    placed = F.rpad(F.concat(F.repeat(F.lit("\0"), ahead), cutout), width, "\0")
    return examples.where("key IS NOT NULL AND window IS NOT NULL AND offset IS NOT NULL AND cls IS NOT NULL").select("key", placed.alias("placed"), ahead.cast("int").alias("lo"), hi.cast("int").alias("hi"), "cls", F.col("n").cast("long").alias("n"))


def _letters_of(rows: DataFrame) -> list[str]:
    """Every character of placed rows, an alphabet's length of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen |= set(_text(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["c"])

    return sorted(r["c"] for r in rows.select("placed").mapInArrow(run, "c string").distinct().collect() if r["c"] != "\0")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that a node has enough rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _walk(table: pa.Table, tree: _Subtree, top: dict[str, dict[str, tuple[int, int] | None]]) -> Iterator[tuple[str, str, np.ndarray]]:
    """(key, node, rows): where the rows of a table stand below the splits of ``top``, which has (place of the distance, feature) by key and node."""
    keys = table.column("key").combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(keys.dictionary) + 1))
    for i, key in enumerate(keys.dictionary.to_pylist()):
        waiting = [("", order[cuts[i] : cuts[i + 1]])]
        while waiting:
            node, rows = waiting.pop()
            split = top.get(key, {}).get(node)
            if split is None:
                yield key, node, rows
            elif len(rows):
                side = tree.side(rows, *split)
                waiting += [(node + "1", rows[~side]), (node + "0", rows[side])]


def _level(rows: DataFrame, groups: Groups, top: dict, open_nodes: set[tuple[str, str]]) -> DataFrame:
    """The nodes ``open_nodes``, split by all tasks together: columns of ``TREE``, and ``size``, ``size_left``, how many examples a node has and sends left."""
    spark = rows.sparkSession
    asked = {key for key, _ in open_nodes}
    model = spark.sparkContext.broadcast((groups, top, open_nodes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_groups, own_top, own_open = model.value
        sums: dict[tuple[str, str, str | None], np.ndarray] = {}
        for table in _chunks(batches):
            tree = _Subtree.placed(table, own_groups)
            names = table.column("cls").combine_chunks().dictionary_encode()
            classes, n = names.indices.to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
            for key, node, at in _walk(table, tree, own_top):
                if (key, node) in own_open and len(at):
                    of, own = np.unique(classes[at], return_inverse=True)
                    left = tree._left(at, own, n[at], len(of))
                    found = [(names.dictionary[int(c)].as_py(), left[:, i], np.bincount(own, n[at])[i]) for i, c in enumerate(of)]
                    every = tree._left(at, np.zeros_like(own), np.ones(len(at)), 1)[:, 0]
                    for cls, counts, whole in [*found, (None, every, len(at))]:
                        counts = np.append(counts, whole)
                        sums[key, node, cls] = sums[key, node, cls] + counts if (key, node, cls) in sums else counts
        columns = [[k for k, _, _ in sums], [x for _, x, _ in sums], [c for _, _, c in sums], [x.tobytes() for x in sums.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["key", "node", "cls", "counts"])

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[str | None, np.ndarray] = {}
        for cls, counts in zip(pdf["cls"], pdf["counts"], strict=True):
            cls, counts = None if pd.isna(cls) else cls, np.frombuffer(counts)
            sums[cls] = sums[cls] + counts if cls in sums else counts
        sizes = sums.pop(None)
        names = sorted(sums)
        counts = np.stack([sums[x] for x in names], 1)
        best = _best(counts[:-1], counts[-1])
        own_groups = model.value[0]
        if best is None:
            row = (*key, None, None, None, _ordered(names, counts[-1]), int(sizes[-1]), None)
        else:
            j, k = divmod(best, len(own_groups))
            row = (*key, DISTANCES[j], *own_groups[k], None, int(sizes[-1]), int(sizes[best]))
        out = pd.DataFrame([row], columns=["key", "node", "delta", "feature", "literals", "classes", "size", "size_left"])
        return out.astype({"delta": "Int32", "size": "Int64", "size_left": "Int64"})

    counted = rows.where(F.col("key").isin(*asked)).mapInArrow(count, "key string, node string, cls string, counts binary")
    return counted.groupBy("key", "node").applyInPandas(choose, TREE + ", size long, size_left long")


def _at_nodes(rows: DataFrame, groups: Groups, top: dict) -> DataFrame:
    """Placed rows with the ``node`` below the splits of ``top`` where they stand."""
    model = rows.sparkSession.sparkContext.broadcast((groups, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_groups, own_top = model.value
        for table in _chunks(batches):
            nodes, codes = [], np.zeros(table.num_rows, np.int32)
            for _, node, at in _walk(table, _Subtree.placed(table, own_groups), own_top):
                codes[at] = len(nodes)
                nodes.append(node)
            named = pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(nodes, pa.string())).cast(pa.string())
            yield from table.append_column("node", named).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(run, "key string, placed string, lo int, hi int, cls string, n long, node string")


def _finished(rows: DataFrame, groups: Groups, nodes: int) -> DataFrame:
    """The subtrees of (key, node) groups of at most ``NODE_BYTES``, some ``nodes`` of them, each made by one task."""
    # more parts than nodes, so that few nodes share a task
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(3 * nodes, 2000))

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        names = table.column("cls").combine_chunks().dictionary_encode()
        tree = _Subtree.placed(table, groups).without_copies()
        classes, n = names.indices.to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)
        made = list(tree.grow(classes, n, names.dictionary.to_pylist(), key[1].as_py()))
        columns = [[key[0].as_py()] * len(made), *map(list, zip(*made, strict=True))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)], ["key", "node", "delta", "feature", "literals", "classes"])

    return rows.repartition(parts, "key", "node").groupBy("key", "node").applyInArrow(finish, TREE)


def grow(examples: DataFrame, groups: Groups) -> DataFrame:
    """Grow the trees of all keys: ``key, node, delta, feature, literals, classes``; leaves have no feature, other nodes no classes.

    Nodes of more than ``NODE_BYTES`` are split level by level by all tasks together: each task counts its own examples
    below the splits so far, which are few, and only counts by (distance, feature, class) are shuffled. Then each
    example goes to its node, and nodes are finished whole, by a task each, whatever their depth. Every example reaches a leaf.
    """
    groups = [(label, [x for x in own if x]) for label, own in groups]
    rows = cut(_placed(examples, groups))
    groups = [*groups, *((c, [c]) for c in _letters_of(rows))]
    held = EXAMPLE_BYTES + 4 * (2 * SCOPE + _longest(groups))
    place = {label: k for k, (label, _) in reversed(list(enumerate(groups)))}
    sizes = rows.groupBy("key").count().collect()  # as many as there are letters
    open_nodes, top, out = {(r["key"], "") for r in sizes if r["count"] * held > NODE_BYTES}, {}, []
    while open_nodes:
        level = cut(_level(rows, groups, top, open_nodes))
        open_nodes = set()
        for r in level.select("key", "node", "delta", "feature", "size", "size_left").collect():  # at most one for each node that no task may hold
            if r["feature"] is not None:
                top.setdefault(r["key"], {})[r["node"]] = DISTANCES.index(r["delta"]), place[r["feature"]]
                open_nodes |= {(r["key"], r["node"] + turn) for turn, size in (("0", r["size_left"]), ("1", r["size"] - r["size_left"])) if size * held > NODE_BYTES}
        out.append(level.drop("size", "size_left"))
    done = [(r["key"], r["node"]) for r in _concat(out).where("feature IS NULL").select("key", "node").collect()] if out else []
    at = _at_nodes(rows, groups, top) if top else rows.withColumn("node", F.lit(""))
    for key, node in done:  # large leaves
        at = at.where(~((F.col("key") == key) & (F.col("node") == node)))
    return _concat([*out, cut(_finished(at, groups, len(sizes) + sum(map(len, top.values()))))])


def _concat(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def predict(rows: DataFrame, tree: DataFrame, most_nodes: int = MODEL_NODES) -> DataFrame:
    """Add ``classes`` (by frequency, from the leaf) to (key, window, offset, ...) rows; unknown keys get null.

    Each different (key, window, offset) walks its tree once. A model of at most ``most_nodes``
    nodes is sent to the tasks; a larger one is joined level by level.
    """
    at = rows.select("key", "window", "offset").where("key IS NOT NULL AND window IS NOT NULL AND offset IS NOT NULL").distinct()
    done = _walked(at, tree) if tree.count() <= most_nodes else _joined(at, tree)
    return rows.join(done, ["key", "window", "offset"], "left")


class _Model:
    """A tree table as arrays, as tasks hold it: nodes by number, features by number, and the classes of leaves as Arrow keeps them."""

    def __init__(self, tree: DataFrame):
        # literals in one string, each behind a mark: few different ones, which Arrow numbers
        told = F.array_join(F.transform("literals", lambda x: F.concat(F.lit("\0"), x)), "")
        table = tree.select("key", "node", "delta", F.when(F.col("delta").isNotNull(), told).alias("told"), "classes").toArrow().combine_chunks()
        named = {name: n for n, name in enumerate(zip(table["key"].to_pylist(), table["node"].to_pylist(), strict=True))}
        self.roots = {key: n for (key, node), n in named.items() if node == ""}
        self.inner = table["delta"].is_valid().to_numpy()
        below = [(named[key, node + "0"], named[key, node + "1"]) if inner else (-1, -1) for (key, node), inner in zip(named, self.inner.tolist(), strict=True)]
        self.left, self.right = np.array(below, np.int32).reshape(-1, 2).T.copy()
        self.deltas, self.place = np.unique(table["delta"].fill_null(0).to_numpy(), return_inverse=True)
        told = table["told"].combine_chunks().dictionary_encode()
        self.feature = told.indices.fill_null(0).to_numpy()
        self.groups = [("", x.split("\0")[1:]) for x in told.dictionary.to_pylist()]
        self.classes = table["classes"].combine_chunks()

    def leaves(self, keys: pa.Array, windows: pa.Array, offsets: pa.Array) -> np.ndarray:
        """The leaf of each row by number, -1 without a tree; all rows go down together, a level at a time."""
        keys = keys.dictionary_encode()
        node = np.array([self.roots.get(k, -1) for k in keys.dictionary.to_pylist()], np.int64)[keys.indices.to_numpy()]
        codes, holds = self._met(windows, offsets.to_numpy())
        rows = np.flatnonzero(node >= 0)
        rows = rows[self.inner[node[rows]]]
        while len(rows):
            at = node[rows]
            goes_left = holds[codes[self.place[at], rows], self.feature[at]] == 1
            node[rows] = np.where(goes_left, self.left[at], self.right[at])
            rows = rows[self.inner[node[rows]]]
        return node

    def _met(self, windows: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the beginnings at each distance of each row, which features they meet)."""
        texts = windows.to_pylist()
        text = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        chars, letters = np.unique(text, return_inverse=True)
        letters = np.append(letters + 1, 0)
        length = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(length) - length
        start = offsets[None, :].astype(np.int64) + self.deltas[:, None]
        inside = (start >= 0) & (start < length)
        codes, names = np.zeros(start.shape, np.int64), [""]
        for k in range(_longest(self.groups)):
            own = letters[np.where(inside & (start + k < length), begin + start + k, len(text))]
            seen, codes = np.unique(codes * (len(chars) + 1) + own, return_inverse=True)
            codes = codes.reshape(start.shape)
            pairs = [divmod(x, len(chars) + 1) for x in seen.tolist()]
            names = [names[x] + chr(chars[c - 1]) if c else names[x] for x, c in pairs]
        holds = _holds(names, self.groups)
        holds[np.ix_([x != "" for x in names], ["" in own for _, own in self.groups])] = 1
        return codes, holds


def _walked(at: DataFrame, tree: DataFrame) -> DataFrame:
    model = at.sparkSession.sparkContext.broadcast(_Model(tree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            leaves = own.leaves(*(batch.column(c) for c in ("key", "window", "offset")))
            classes = own.classes.take(pa.array(leaves, mask=leaves < 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "window", "offset")), classes], ["key", "window", "offset", "classes"])

    return at.mapInArrow(run, f"key string, window string, offset {at.schema['offset'].dataType.simpleString()}, classes {LEAF}")


def _joined(at: DataFrame, tree: DataFrame) -> DataFrame:
    tree = cut(tree)
    at, out = at.withColumn("node", F.lit("")), None
    while True:
        met = at.join(tree.select("key", "node", "delta", "literals", "classes"), ["key", "node"])
        ended = met.where("delta IS NULL").select("key", "window", "offset", "classes")
        out = ended if out is None else out.unionByName(ended)
        left = matches(F.col("window"), F.col("offset"), F.col("delta"), F.col("literals"))
        at = cut(met.where("delta IS NOT NULL").select("key", "window", "offset", _child(F.col("node"), left).alias("node")))
        if at.isEmpty():
            return out


def alternate_classes(tree: DataFrame) -> DataFrame:
    """``key, cls, leaves``: in how many leaves of a key a class stands."""
    return tree.where("feature IS NULL").select("key", F.explode("classes.cls").alias("cls")).groupBy("key", "cls").agg(F.count("*").alias("leaves"))
