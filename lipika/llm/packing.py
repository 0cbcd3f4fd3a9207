"""Mixture-controlled packing by deficit round-robin over source queues.

A window is ``WINDOW`` tokens of output. In each, every queue is granted its quantum: its target
share of the window. What a queue is owed but can't send in whole units of ``UNIT`` tokens is its
deficit, which it carries to the next window, so after any number of windows a queue has sent its
share to within one unit. The target is the corpus's own mixture, unless ``targets`` says otherwise.

A queue's tokens are cut into units, and unit ``u`` of ``units`` goes to window ``(u + phase) * windows
// units``: evenly, each queue with a phase of its own, so that small sources do not all send at
once. So the deficits at the start of a window follow from its number; tasks need no state from
one another. Spark makes the table of who sends how much in which window, for any number of
sources, and sums it up to places in the output. When a queue with a target runs dry, a new stretch
of windows begins, in which its quantum is split among the others in proportion to theirs.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import byte_bpe, tokenizer_path

SEQUENCE = 1024
#: Tokens in which the mixture holds: 64 sequences.
WINDOW = 64 * SEQUENCE
#: Tokens that a queue sends at least, unless its end comes first: texts of small sources are not cut to single tokens.
UNIT = 64
END = 0
#: Windows whose sums are added up by one task.
STRIP = 10_000


def stretches(lengths: dict, targets: dict) -> list[dict]:
    """The tokens that each class of sources sends in each stretch, for few classes with target weights; a stretch ends when a class runs dry.

    A class of weight 0 waits until only such are left, and these then share by what they have.
    """
    left, out = {c: n for c, n in lengths.items() if n > 0}, []
    while left:
        weights = {c: targets[c] for c in left if targets[c] > 0} or dict(left)
        dry = min(weights, key=lambda c: (left[c] / weights[c], str(c)))
        share = {c: left[c] if c == dry else min(left[c], int(left[dry] * w / weights[dry])) for c, w in weights.items()}
        out.append(share)
        left = {c: n - share.get(c, 0) for c, n in left.items() if n > share.get(c, 0)}
    return out


def tokenize(docs: DataFrame, path: str | None = None, end: int | None = END) -> DataFrame:
    """``doc_id, source, ids, n, part, before`` of (doc_id, source, text) rows.

    ``ids`` are 16-bit little-endian numbers, with ``end`` after each text; ``n`` is their number;
    ``part`` is the task's partition, and ``before`` the tokens of the same source that precede
    in it. The three last agree with each other only as one run has made them: write the rows
    before using them twice.
    """
    path = path or tokenizer_path()
    tail = b"" if end is None else int(end).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, totals = byte_bpe(path, special=True), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            sources, ids, before = batch.column("source").to_pylist(), [], []
            for text, source in zip(batch.column("text").to_pylist(), sources, strict=True):
                ids.append(encode(text) + tail)
                before.append(totals[source])
                totals[source] += len(ids[-1]) // 2
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            columns = [batch.column("doc_id"), batch.column("source"), pa.array(ids, pa.binary()), n, pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "ids", "n", "part", "before"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, ids binary, n long, part int, before long")


def _queues(parts: DataFrame, targets: dict[str | None, float] | None, window: int) -> DataFrame:
    """``of, first, tokens, base, windows`` of (part, source, n) sums: for each stretch of a source its first token and number of tokens, the stretch's first window and its windows."""
    sums = parts.groupBy("source").agg(F.sum("n").alias("all"))
    named = targets or {}
    # a class is a source with a target, or all others together; the classes are as many as the targets
    own = F.lit(-1)
    for k, name in enumerate(named):
        own = F.when(F.col("source").eqNullSafe(F.lit(name)), k).otherwise(own)
    sums = materialize(sums.withColumn("class", own), "source-sums")
    lengths = {r["class"]: r["n"] for r in sums.groupBy("class").agg(F.sum("all").alias("n")).collect()}
    weights = dict(enumerate(named.values())) | {-1: max(0.0, 1.0 - sum(named.values()))}
    each, sent, base = [], dict.fromkeys(lengths, 0), 0
    for share in stretches(lengths, weights):
        windows = -(-sum(share.values()) // window)
        for c, n in share.items():
            # a source's tokens of a stretch are its class's, in proportion and rounded down at either end
            first, end = (F.expr(f"CAST(CAST(all AS DECIMAL(20, 0)) * {x} DIV {lengths[c]} AS BIGINT)") for x in (sent[c], sent[c] + n))
            each.append(F.when(F.col("class") == c, F.struct(first.alias("first"), (end - first).alias("tokens"), F.lit(base).cast("long").alias("base"), F.lit(windows).cast("long").alias("windows"))))
        sent = {c: sent[c] + share.get(c, 0) for c in sent}
        base += windows
    none = F.lit(None).cast("struct<first:bigint,tokens:bigint,base:bigint,windows:bigint>")
    return sums.select(F.col("source").alias("of"), F.explode(F.array_compact(F.array(none, *each))).alias("q")).select("of", "q.*").where("tokens > 0")


def _schedule(parts: DataFrame, targets: dict[str | None, float] | None, window: int, unit: int) -> DataFrame:
    """``of_part, of_source, base, spans``: where the queue of a source stands when a part begins, and the spans of it that the part sends.

    A span has its ``first`` token in the queue, where it ends (``upto``), its place ``at`` in the
    output and its ``window``.
    """
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.select("part", "source", "n", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("place"))
    queues = _queues(parts, targets, window)
    rows = based.join(queues, based["source"].eqNullSafe(queues["of"])).withColumn("units", F.ceil(F.col("tokens") / unit).cast("decimal(20,0)")).withColumn("phase", F.pmod(F.xxhash64("source"), F.lit(65_536)))
    low, high = F.greatest("place", "first") - F.col("first"), F.least(F.col("place") + F.col("n"), F.col("first") + F.col("tokens")) - F.col("first")
    rows = rows.withColumn("u0", F.floor(low / unit)).withColumn("u1", F.floor((high - 1) / unit)).where(high > low)
    # whole numbers throughout: a window of a unit and the first unit of a window must agree
    number = lambda u: F.expr(f"CAST((CAST({u} AS DECIMAL(20, 0)) * 65536 + phase) * windows DIV (units * 65536) AS BIGINT)")
    rows = rows.withColumn("w0", number("u0")).withColumn("w1", number("u1"))
    some = F.expr("CASE WHEN w1 - w0 <= u1 - u0 THEN sequence(w0, w1) ELSE array_distinct(transform(sequence(u0, u1), u -> CAST((CAST(u AS DECIMAL(20, 0)) * 65536 + phase) * windows DIV (units * 65536) AS BIGINT))) END")
    sent = materialize(rows.select("part", "source", "place", "first", "tokens", "base", "windows", "units", "phase", F.explode(some).alias("w")), "part-windows")
    # the first unit of a window: whole division rounds up after adding one less than the divisor
    opens = lambda w: F.expr(f"CAST(least(units, greatest(0, ((CAST({w} AS DECIMAL(20, 0)) * units * 65536 + windows - 1) DIV windows - phase + 65535) DIV 65536)) AS BIGINT)")
    grants = sent.select("source", "first", "tokens", (F.col("base") + F.col("w")).alias("window"), opens("w").alias("a"), opens("(w + 1)").alias("b")).distinct()
    grants = grants.select("source", "window", (F.col("first") + F.col("a") * unit).alias("from"), (F.col("first") + F.least(F.col("b") * unit, F.col("tokens"))).alias("upto")).where("upto > from")
    grants = materialize(grants.withColumn("strip", F.floor(F.col("window") / STRIP)), "grants")
    sums = grants.groupBy("strip", "window").agg(F.sum(F.col("upto") - F.col("from")).alias("n"))
    ahead = lambda order, by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    strips = sums.groupBy("strip").agg(F.sum("n").alias("n")).select(F.col("strip").alias("of_strip"), ahead("strip", []).alias("before"))
    starts = sums.join(strips, F.col("strip") == F.col("of_strip")).select(F.col("window").alias("of_window"), (F.col("before") + ahead("window", ["strip"])).alias("start"))
    grants = grants.withColumn("n", F.col("upto") - F.col("from")).withColumn("inside", ahead("source", ["window"])).join(starts, F.col("window") == F.col("of_window"))
    grants = grants.select(F.col("source").alias("of"), F.struct(F.col("from").alias("first"), "upto", (F.col("start") + F.col("inside")).alias("at"), "window").alias("span"))
    needed = sent.select("part", "source", "place", (F.col("base") + F.col("w")).alias("needed"))
    found = needed.join(grants, needed["source"].eqNullSafe(grants["of"]) & (needed["needed"] == grants["span"]["window"]))
    return found.groupBy(F.col("part").alias("of_part"), F.col("source").alias("of_source"), F.col("place").alias("base")).agg(F.sort_array(F.collect_list("span")).alias("spans"))


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, window: int = WINDOW, unit: int = UNIT, targets: dict[str | None, float] | None = None, with_ids: bool = False) -> DataFrame:
    """Pack (doc_id, source, text) rows into sequences of ``sequence`` tokens with the target mixture in every window.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source, window`` (and ``ids``, 32-bit little-endian). Only the very last sequence can be short.
    ``targets`` gives shares of a window by source; the sources that it doesn't name share what
    they leave, by their lengths. Every document is packed: when a source runs dry, the others take
    over its share, and sources of share 0 come last. A null or empty text is its end token; a null
    source is a queue of its own; repeated rows are packed each; an empty table gives no rows;
    other columns are ignored. Queue order is the order in which Spark reads the table. The tokens
    are written to the shared folder once, and shuffled once to meet their places.
    """
    tokens = materialize(tokenize(docs, path), "tokens")
    parts = materialize(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "token-sums")
    base = materialize(_schedule(parts, targets, window, unit), "queue-places")
    # alike at every size: the places of a large corpus are too many to broadcast
    placed = tokens.join(base.hint("merge"), (tokens["part"] == base["of_part"]) & tokens["source"].eqNullSafe(base["of_source"])).withColumn("place", F.col("base") + F.col("before"))
    own = F.filter("spans", lambda x: (x["upto"] > F.col("place")) & (x["first"] < F.col("place") + F.col("n")))
    placed = placed.select("doc_id", "source", "ids", "place", own.alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, source, raw, place, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                for span in spans:
                    start, end = max(0, span["first"] - place), min(len(ids), span["upto"] - place)
                    at = span["at"] + place + start - span["first"]
                    while start < end:  # a piece ends with its sequence
                        take = min(end - start, sequence - at % sequence)
                        own = ids[start : start + take].tobytes()
                        rows.append((doc, start, take, zlib.crc32(own), len(ids), at // sequence, at % sequence, source, span["window"], own if with_ids else None))
                        start, at = start + take, at + take
            types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.string(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window", "ids"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long, ids binary")
    return out if with_ids else out.drop("ids")
