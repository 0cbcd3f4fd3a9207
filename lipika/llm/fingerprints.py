"""Document fingerprints: a quartile bucket digest of hashed byte triplets, and a bounded difference score.

Byte triplets of several ``SHAPES``, from adjacent bytes to a window of eight, are taken at every
place of a text and hashed into ``BUCKETS`` counts. The
digest has the text's length on a logarithmic scale (one byte) and for every bucket two bits: how
many of the three quartiles of the counts it exceeds. Similar texts have similar counts, so their
digests differ in few buckets and by small steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Where a triplet's bytes stand in the window; wide triplets tell a text from others in its language better than close ones,
#: which even a text of 3 bytes has.
SHAPES = ((0, 3, 7), (0, 1, 2), (0, 1, 3), (0, 2, 4))
#: What bucket codes 0 to 3 that differ by 0, 1, 2, 3 add to the difference.
STEP = np.array([0, 1, 2, 6])
LENGTH_BASE = 1.1
#: Mean step between codes that have nothing to do with each other (each of the 16 pairs alike).
UNRELATED = float(np.mean([[STEP[abs(i - j)] for i in range(4)] for j in range(4)]))
#: A range has about this many documents, or more where there would be more than ``MOST_PARTS``.
DOCUMENTS_A_PART = 5_000
MOST_PARTS = 20_000


def _counts(data: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for k, (a, b, c) in enumerate(SHAPES):
        n = len(data) - c
        if n > 0:
            wide = data.astype(np.uint32)
            mixed = (wide[a : a + n] * np.uint32(0x9E3779B1)) ^ (wide[b : b + n] * np.uint32(0x85EBCA77)) ^ (wide[c:] * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out += np.bincount(mixed >> np.uint32(22), minlength=BUCKETS)
    return out


def digest(text: bytes) -> bytes:
    """The fingerprint: length byte, then 2 bits a bucket. A text of fewer than 3 bytes has all buckets at 0."""
    counts = _counts(np.frombuffer(text, np.uint8))
    quartiles = np.sort(counts)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = (counts[:, None] > quartiles).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    size = min(255, int(np.log1p(len(text)) / np.log(LENGTH_BASE)))
    return bytes([size]) + packed.astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 less the bounded difference: 1.0 for equal digests, 0.0 from the difference of unrelated counts on."""
    x, y = (np.frombuffer(d, np.uint8) for d in (a, b))
    codes = [np.stack([(d[1:] >> s) & 3 for s in (0, 2, 4, 6)]).astype(np.int8) for d in (x, y)]
    steps = int(STEP[np.abs(codes[0] - codes[1])].sum())
    apart = abs(int(x[0]) - int(y[0]))
    worst = BUCKETS * UNRELATED
    return 1.0 - min(1.0, (steps + 4 * apart) / worst)


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter (in code points, rounded down) replaced by as many, or all, of the next text's first."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _longs(values: list[int]) -> str:
    return "array(" + ",".join(f"{v}L" if v > LEAST else "(-9223372036854775807L - 1L)" for v in values) + ")"


#: Stands for a null doc_id, which comes before all others.
LEAST = -(2**63)


def _range_of(cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id, found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    wide = int(len(cuts) ** 0.5) + 1
    rows = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    upto = lambda values: F.size(F.filter(values, lambda c: c <= F.coalesce("doc_id", F.lit(LEAST))))
    row = upto(F.expr(_longs([r[0] for r in rows])))
    return F.when(row == 0, 0).otherwise((row - 1) * wide + upto(F.element_at(F.expr(f"array({','.join(map(_longs, rows))})"), row)))


def neighbours(docs: DataFrame) -> DataFrame:
    """Documents dealt out by ranges of doc_id, each range followed by the first document of the next.

    Adds ``range`` and ``tail``: tail rows are copies that only end a range (after the last range
    comes the first document of all). A range is one partition, sorted by (tail, doc_id, text).
    The ranges' bounds are quantiles of doc_id; only they and the ranges' first ids reach the
    driver, three numbers per partition.
    """
    parts = max(1, min(MOST_PARTS, -(-docs.count() // DOCUMENTS_A_PART)))
    cuts = docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    dealt = docs.withColumn("range", _range_of(sorted({int(c) for c in cuts})))
    key = F.coalesce("doc_id", F.lit(LEAST))
    firsts = dict(dealt.groupBy("range").agg(F.min(key)).collect())
    order = sorted(firsts)
    if not order:
        return docs.withColumn("range", F.lit(0)).withColumn("tail", F.lit(False))
    # by range: its first id, and the range that it follows
    first = [firsts.get(r, LEAST) for r in range(order[-1] + 1)]
    prior = {r: order[k - 1] for k, r in enumerate(order)}
    follows = F.element_at(F.expr("array(" + ",".join(str(prior.get(r, 0)) for r in range(order[-1] + 1)) + ")"), F.col("range") + 1)
    opens = key == F.element_at(F.expr(_longs(first)), F.col("range") + 1)
    copies = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")), F.struct(F.when(opens, follows).alias("range"), F.lit(True).alias("tail")))
    rows = dealt.select("doc_id", "text", F.explode(F.filter(copies, lambda c: c["range"].isNotNull())).alias("at")).select("doc_id", "text", "at.*")
    return rows.repartitionById(order[-1] + 1, "range").sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), "text")


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint each whole text of (doc_id, text) rows, and its edited text made with the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The next document is the next in order of (doc_id, text), null ids first, and
    after the last comes the first, so ties and repeated rows have one result; a lone document is
    its own next. A null text is empty; a text that can't be cut in four keeps itself. An empty
    table gives no rows; other columns are ignored. Texts are shuffled once, by ranges.
    """
    rows = neighbours(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior = None  # (range, doc_id, text, digest), waiting for its next
        for batch in batches:
            out: list[tuple] = []
            for doc, text, part, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and (prior is None or prior[0] != part):
                    continue  # of several equal first documents, the first copy has served
                own = digest(text.encode())
                if prior is not None and prior[0] == part:
                    edited = edit(prior[2], text).encode()
                    changed = digest(edited)
                    out.append((prior[1], len(prior[2]), hashlib.sha256(edited).hexdigest(), prior[3].hex(), changed.hex(), likeness(prior[3], changed), likeness(prior[3], own)))
                prior = None if tail else (part, doc, text, own)
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.select("doc_id", "text", "range", "tail").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
