"""Toxicity: two class-conditional Kneser-Ney models over bytes, compared per byte of text.

Each class (toxic, ordinary) has interpolated Kneser-Ney counts for the byte n-grams of orders
``ORDER`` down to 3; below that both back off to one shared model, so what either class has hardly
seen is judged alike by both. A text's evidence is the difference of its two log-likelihoods
divided by its length, for the whole text and for its ``TOP`` most toxic windows; a logistic
function turns it into a probability. It is fitted on learning rows that are outside the counts at
that time; the final model counts every labelled learning row.

The model is exact n-grams in tables that grow with the corpus. Texts are scored in blocks: each
block's distinct n-grams are joined to the tables and return to the block with their differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_path, materialize, materialize_at
from .quality import learning_fold

ORDER = 5
SHARED = 2
#: Bytes of text that are looked up together, about.
BLOCK = 16_000_000
WINDOW = 24
TOP = 4
#: Rows the logistic function is fitted on, at most.
CALIBRATION_ROWS = 6_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngrams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte of a text (A-Z lowered, line feeds before its start), as integers."""
    data = _LOWER[np.frombuffer(b"\n" * (order - 1) + text, np.uint8)].astype(np.uint64)
    n = len(text)
    out = np.zeros(n, np.uint64)
    for j in range(order):
        out = out << np.uint64(8) | data[j : j + n]
    return out


def calibration_fold(doc_id: Column) -> Column:
    """A quarter of the learning rows, of which those are drawn that the logistic function is fitted on."""
    return F.floor(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) / 3) % 4 == 0


def count_ngrams(learning: DataFrame) -> DataFrame:
    """``key, toxic, ordinary``: how often each highest-order n-gram stands in (text, label) rows of either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), dtype=np.int64)
            texts = batch.column("text").to_pylist()
            for own in (0, 1):
                size, pending = 0, []
                chosen = [t for t, m in zip(texts, labels, strict=True) if m == own and t]
                for k, text in enumerate(chosen):
                    pending.append(ngrams(text.encode()))
                    size += len(pending[-1])
                    if size > 2_000_000 or k == len(chosen) - 1:
                        keys, n = np.unique(np.concatenate(pending), return_counts=True)
                        none = np.zeros(len(n), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n if own else none), pa.array(none if own else n)], ["key", "toxic", "ordinary"])
                        size, pending = 0, []

    parts = learning.select("text", F.col("label").cast("long").alias("label")).mapInArrow(run, "key long, toxic long, ordinary long")
    return parts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _suffix(order: int) -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _shorter(grams: DataFrame, order: int) -> DataFrame:
    """Kneser-Ney continuation counts of n-grams of ``order``: in how many different n-grams of the next order they stand."""
    return grams.groupBy(_suffix(order).alias("key")).agg(F.sum((F.col("toxic") > 0).cast("long")).alias("toxic"), F.sum((F.col("ordinary") > 0).cast("long")).alias("ordinary"))


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def _shared_chances(keys: np.ndarray, n: np.ndarray, once: dict[int, float]) -> np.ndarray:
    """The shared model's probability of each seen n-gram of order 2; ``n``: counts of both classes, ``once``: discounts."""

    def step(n, context, discount, lower):
        total, types = np.bincount(context, n, 256), np.bincount(context, minlength=256)
        return np.maximum(n - discount, 0) / np.maximum(total[context], 1) + discount * types[context] / np.maximum(total[context], 1) * lower

    return step(n[2], keys[2] >> 8, once[2], step(n[1], np.zeros(len(keys[1]), np.int64), once[1], 1 / 256)[np.searchsorted(keys[1], keys[2] & 255)])


class DifferenceTables:
    """The two models as tables of log-likelihood differences: of seen n-grams, and of backing off from seen contexts.

    No n-gram and no context is merged with another, and none leaves its table: the driver sees the
    counts of orders 1 and 2 only (at most 65,792). A join key has at most 256 rows on the tables' side.
    """

    def __init__(self, counts: DataFrame):
        spark, self.paths, self.seen, self.back = counts.sparkSession, [], {}, {}
        grams = {ORDER: counts}
        for order in range(ORDER - 1, SHARED, -1):
            grams[order] = self._kept(_shorter(grams[order + 1], order), f"ngrams-{order}")
        few = _shorter(grams[SHARED + 1], SHARED).toPandas().sort_values("key")
        ones = few.assign(key=few["key"] & 255, toxic=few["toxic"] > 0, ordinary=few["ordinary"] > 0).groupby("key")[["toxic", "ordinary"]].sum()
        keys = {1: ones.index.to_numpy(np.int64), 2: few["key"].to_numpy(np.int64)}
        both = {1: ones.to_numpy(np.float64).sum(1), 2: few[["toxic", "ordinary"]].to_numpy(np.float64).sum(1)}
        shared = {order: _discount((n == 1).sum(), (n == 2).sum()) for order, n in both.items()}
        low = list(zip(keys[2].tolist(), _shared_chances(keys, both, shared).tolist(), strict=True))
        lower = F.broadcast(spark.createDataFrame([(k, p, p) for k, p in low], "key long, p0 double, p1 double"))
        for order in range(SHARED + 1, ORDER + 1):
            whole = Window.partitionBy("context")
            rows, chances = grams[order].withColumn("context", F.shiftright("key", 8)).withColumn("low", _suffix(order - 1)), []
            of = grams[order].agg(*[F.count_if(F.col(c) == n) for c in ("toxic", "ordinary") for n in (1, 2)]).first()
            for k, c in enumerate(("toxic", "ordinary")):
                discount, total = _discount(of[2 * k], of[2 * k + 1]), F.sum(c).over(whole)
                types = F.sum((F.col(c) > 0).cast("long")).over(whole)
                chances += [(F.greatest(F.col(c) - discount, F.lit(0.0)) / F.greatest(total, F.lit(1))).alias(f"direct{k}"), F.when(total > 0, discount * types / total).otherwise(1.0).alias(f"keeps{k}")]
            rows = rows.select("key", "context", "low", *chances).join(lower.withColumnRenamed("key", "low"), "low")
            gap = lambda p, q, least: F.log(p + least) - F.log(q + least)
            p0, p1 = (F.col(f"direct{k}") + F.col(f"keeps{k}") * F.col(f"p{k}") for k in (0, 1))
            table = self._kept(rows.select("key", "context", p0.alias("p0"), p1.alias("p1"), gap(F.col("keeps0"), F.col("keeps1"), 1e-6).alias("back")), f"chances-{order}")
            self.seen[order] = table.select("key", gap(F.col("p0"), F.col("p1"), 1e-12).alias(f"seen{order}"))
            self.back[order] = table.groupBy("context").agg(F.min("back").alias(f"back{order}"))
            lower = table.select("key", "p0", "p1")

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        out, path = materialize_at(rows, name)
        self.paths.append(path)
        return out

    def of(self, keys: DataFrame) -> DataFrame:
        """``key, difference`` of different n-grams of the highest order."""
        # what the highest order has not seen is looked up further
        seen = self._kept(keys.join(self.seen[ORDER].hint("merge"), "key", "left").select("key", F.col(f"seen{ORDER}").alias("difference")), "seen-ngrams")
        out, value = seen.where(F.col("difference").isNull()).select("key"), F.lit(0.0)
        for order in range(ORDER, SHARED, -1):
            own = _suffix(order)
            if order < ORDER:
                out = out.withColumn("own", own).join(self.seen[order].withColumnRenamed("key", "own"), "own", "left").drop("own")
            back = self.back[order].withColumnRenamed("context", "at")
            # the contexts of the lowest order are 65,536 at most
            out = out.withColumn("at", F.shiftright(own, 8)).join(F.broadcast(back) if order == SHARED + 1 else back, "at", "left").drop("at")
        for order in range(SHARED + 1, ORDER + 1):
            value = F.coalesce(f"back{order}", F.lit(0.0)) + value
            value = F.coalesce(f"seen{order}", value) if order < ORDER else value
        return seen.where(F.col("difference").isNotNull()).unionByName(out.select("key", value.alias("difference")))


def evidence(each: np.ndarray) -> list[float]:
    """Length-normalised sums of a text's differences: of the whole text, then of its most toxic windows, each apart from the last."""
    if not len(each):
        return [0.0] * (TOP + 2)
    total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
    width = min(WINDOW, len(each))
    windows = (total[width:] - total[:-width]) / WINDOW
    tops = []
    for _ in range(TOP):
        k = int(windows.argmax())
        best = float(windows[k])
        tops.append(max(best, -1.0))
        if best > -1.0:
            windows[max(0, k - width + 1) : k + width] = -9.0
    return [float(total[-1]) / len(each), *tops, float(np.log1p(len(each))) / 10]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the constant last) by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


class ToxicityModel:
    def __init__(self, tables: DifferenceTables, weights: np.ndarray):
        self.tables, self.weights = tables, weights


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit the logistic function on a bounded sample kept out of the counts, then count that sample too.

    Labels that are null or of held-out rows are not read; documents of one id share its largest
    label. Without labels of both kinds every text scores 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & learning_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # labels grow with the corpus: a shuffle join at every size
    texts = docs.where(F.col("text").isNotNull() & learning_fold(F.col("doc_id"))).select("doc_id", "text").join(known.hint("merge"), "doc_id")
    spark = docs.sparkSession
    drawn = known.where(calibration_fold(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS)
    drawn, drawn_path = materialize_at(drawn, "calibration-rows")
    of = F.broadcast(drawn.select("doc_id"))  # CALIBRATION_ROWS at most
    most, most_path = materialize_at(count_ngrams(texts.join(of, "doc_id", "left_anti")), "ngram-counts")
    tables = DifferenceTables(most)
    kept = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # one text for each drawn id, the same whatever the rows' order
    weights = _calibrate(kept.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), tables)
    counts = most.unionByName(count_ngrams(kept)).groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    whole, whole_path = materialize_at(counts, "ngram-counts")
    final = DifferenceTables(whole)
    for path in (*tables.paths, drawn_path, most_path, whole_path):
        drop_path(spark, path)
    return ToxicityModel(final, weights)


def _calibrate(rows: DataFrame, tables: DifferenceTables) -> np.ndarray:
    rows = rows.select("text", F.col("label").cast("long").alias("label"), F.col("doc_id").cast("long").alias("doc_id"))
    found = _with_evidence(rows, tables, "x", T.ArrayType(T.DoubleType()), lambda x: x.tolist()).select("x", "label", "doc_id").collect()
    found.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in found]), np.array([r["label"] for r in found])
    if not len(y) or y.min() == y.max():
        return np.array([0.0] * (TOP + 2) + [-30.0])
    return fit_logistic(x, y)


def _pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in batches:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _packed(values: DataFrame) -> DataFrame:
    """``block, last, rows`` of (block, key, difference) rows: what a task has for a block in a few packed rows, which shuffle at a fraction of the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done():
            block, key, value = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            order = np.lexsort((key, block))
            block, key, value = block[order], key[order], value[order].astype(np.float32)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            made = [_pack([pa.RecordBatch.from_arrays([pa.array(np.diff(key[a:b], prepend=0)), pa.array(value[a:b])], ["step", "difference"])]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array([False] * len(made), pa.bool_()), pa.array(made, pa.binary())], ["block", "last", "rows"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size > 2_000_000:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return values.mapInArrow(run, "block long, last boolean, rows binary")


def _blocks(docs: DataFrame, whole: bool) -> DataFrame:
    """``block, key, rows``: a row for each block of rows, with the block itself, packed, if ``whole``; else also its distinct n-grams, a row each.

    Where a block ends depends on the rows' order alone, so both tables have the same blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, keys = None, [], 0, []

        def done():
            if not whole:
                own = np.unique(np.concatenate(keys)).astype(np.int64)
                yield table([number] * len(own), own, [None] * len(own))
            yield table([number], [None], [_pack(held) if whole else None])

        def table(block, key, rows):
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(key, pa.int64()), pa.array(rows, pa.binary())], ["block", "key", "rows"])

        for part in batches:
            if not part.num_rows:
                continue
            at, batch = 0, pa.RecordBatch.from_struct_array(part.column("page"))
            if number is None:
                number = part.column("part")[0].as_py() << 32
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            pending, waiting = [], 0
            for k, text in enumerate(texts):
                if not whole:
                    pending.append(ngrams(text))
                size, waiting = size + len(text), waiting + len(text)
                full = size >= BLOCK
                if not whole and (waiting > 2_000_000 or full or k == len(texts) - 1):
                    keys.append(np.unique(np.concatenate(pending)))
                    pending, waiting = [], 0
                if full or k == len(texts) - 1:
                    held.append(batch.slice(at, k + 1 - at))
                    at = k + 1
                if full:
                    yield from done()
                    number, held, size, keys = number + 1, [], 0, []
        if held:
            yield from done()

    # the rows' own partition: a task's number is another where this is one part of a union
    numbered = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("page"), F.spark_partition_id().alias("part"))
    return numbered.mapInArrow(run, "block long, key long, rows binary")


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    if len(keys) and not (len(known) and (known[at] == keys).all()):
        raise RuntimeError("a text has n-grams that its block did not look up: the texts were read in another order")
    return at


def _with_evidence(docs: DataFrame, tables: DifferenceTables, name: str, kind: T.DataType, finish) -> DataFrame:
    """Add the column ``name``: what ``finish`` makes of a batch's evidence (a row for each text).

    Only the blocks' n-grams are written; the texts are read again, from where they are, when their
    n-grams' differences are known. An n-gram stands at most once in a block, so that common ones
    are no heavy keys, and a block is one row. Files are read alike each time; rows that come from
    a shuffle, whose parts may be other ones at the next reading, are written first. Blocks meet
    their n-grams by hash, several in a task, one after another.
    """
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialize(docs, "scored-texts")
    pairs = materialize(_blocks(docs, False), "block-ngrams").where(F.col("key").isNotNull()).select("block", "key")
    found = _packed(pairs.join(tables.of(pairs.select("key").distinct()).hint("merge"), "key").select("block", "key", "difference"))
    whole = _blocks(docs, True).select("block", F.lit(True).alias("last"), "rows")
    both = found.unionByName(whole).repartition("block").sortWithinPartitions("block", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        for batch in batches:
            for last, packed in zip(batch.column("last").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if not last:
                    parts.append(packed)
                    continue
                found = [pa.ipc.open_stream(p).read_all() for p in parts]
                known = np.concatenate([np.cumsum(f["step"].to_numpy()) for f in found] or [np.zeros(0, np.int64)])
                order = known.argsort()
                known, worth = known[order], np.concatenate([f["difference"].to_numpy() for f in found] or [np.zeros(0, np.float32)])[order]
                parts = []
                for part in pa.ipc.open_stream(packed):
                    texts = part.column(part.schema.get_field_index("text")).to_pylist()
                    x = [evidence(worth[_places(known, ngrams((t or "").encode()).astype(np.int64))]) for t in texts]
                    made = pa.array(finish(np.array(x).reshape(len(texts), TOP + 2)), to_arrow_type(kind))
                    yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return both.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` (0 to 1, higher: more toxic) to rows with a ``text``, from the whole text alone.

    A null text scores as the empty one, whose score is the logistic function's at no evidence.
    Repeated rows score alike; an empty table stays empty; a former ``score`` column is replaced,
    others pass through.
    """
    weights = model.weights
    return _with_evidence(docs.drop("score"), model.tables, "score", T.DoubleType(), lambda x: 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))
