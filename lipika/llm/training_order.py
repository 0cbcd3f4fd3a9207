"""Token-ID output in training order: a keyed permutation gives every sequence a slot, and slots fill fixed-stride shards.

The texts of a partition, each followed by an end token, form one stream that is cut into
sequences of ``LENGTH`` ids (only a partition's last one is padded). Sequences are numbered densely, and a
balanced Feistel network over the next power of four, walked until it lands below their number,
maps numbers to slots one to one. Shard k has the slots [k * S, (k + 1) * S) in order, so a reader
finds any slot by division and can resume anywhere.

A record is ``LENGTH + 2`` little-endian unsigned 16-bit numbers: how many ids count, the ids
(padding 0), and the mark ``MARK``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, materialize, materialize_at, scratch_path
from .tokens import byte_bpe, tokenizer_path

LENGTH = 4096
END = 50256
SLOTS_A_SHARD = 2048
ROUNDS = 6
#: The last two bytes of a record, 0 and a line feed: the text writer puts the line feed.
MARK = 0x0A00


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """The slots of numbers below ``size``: a permutation of range(size) for each key."""
    half = np.uint64(max(1, -(-(max(size, 2) - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
        out = numbers.astype(np.uint64)
        walk = np.arange(len(out))
        while len(walk):
            left, right = out[walk] >> half, out[walk] & mask
            for k in keys:
                left, right = right, left ^ (_mix(right + k) & mask)
            out[walk] = left << half | right
            walk = walk[out[walk] >= size]
    return out.astype(np.int64)


def slot_of(number: Column, size: int, key: int) -> Column:
    @F.pandas_udf("long")
    def slots(numbers):
        import pandas as pd

        return pd.Series(permute(numbers.to_numpy(), size, key))

    return slots(number)


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, text) rows cut into sequences: ``part, k, first_doc_id, first_start, n_tokens, ids_crc32, packed``.

    ``part`` and ``k`` number the sequences of one reading of the table: write the rows before
    using them twice. ``packed`` is the zstd-compressed ids.
    """
    path = path or tokenizer_path()
    tail = int(end).to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, squeeze, part = byte_bpe(path), zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId()
        held, first, k = bytearray(), None, 0

        def row(ids: bytes):
            return (part, k, *first, len(ids) // 2, zlib.crc32(ids), squeeze.compress(ids))

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        kind = pa.int64()
        for batch in batches:
            rows, kind = [], batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, done = encode(text) + tail, 0
                while done < len(ids):
                    if not held:
                        first = (doc, done // 2)
                    take = min(len(ids) - done, 2 * length - len(held))
                    held += ids[done : done + take]
                    done += take
                    if len(held) == 2 * length:
                        rows.append(row(bytes(held)))
                        held.clear()
                        k += 1
            yield out(rows, kind)
        if held:
            yield out([row(bytes(held))], kind)

    names = ["part", "k", "first_doc_id", "first_start", "n_tokens", "ids_crc32", "packed"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"part int, k long, first_doc_id {kind}, first_start long, n_tokens long, ids_crc32 long, packed binary")


def in_order(cut: DataFrame, key: int, slots_a_shard: int = SLOTS_A_SHARD) -> tuple[DataFrame, int]:
    """Give written sequences their ``number``, ``slot`` and ``shard``; also returns how many there are."""
    parts = materialize(cut.groupBy("part").agg(F.count("*").alias("n")), "sequence-counts")
    size = parts.agg(F.sum("n")).first()[0] or 0
    # partitions in blocks, so that no one task orders all of them
    block = (F.col("part") / 1000).cast("int")
    inside = Window.partitionBy(block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = {r[0]: r[1] for r in parts.groupBy(block.alias("b")).agg(F.sum("n")).collect()}  # a number per 1000 partitions
    ahead, run = [], 0
    for b in range(max(blocks, default=-1) + 1):
        ahead.append(run)
        run += blocks.get(b, 0)
    before = F.element_at(F.expr(f"array({','.join(f'{x}L' for x in ahead or [0])})"), block + 1)
    base = materialize(parts.select(F.col("part").alias("of"), (before + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base")), "sequence-places")
    placed = cut.join(base, cut["part"] == base["of"]).drop("of").withColumn("number", F.col("base") + F.col("k")).drop("base")
    placed = placed.withColumn("slot", slot_of(F.col("number"), size, key))
    return placed.withColumn("shard", F.floor(F.col("slot") / slots_a_shard).cast("int")), size


def stride(length: int = LENGTH) -> int:
    return 2 * length + 4


def write_shards(placed: DataFrame, size: int, path: str, length: int = LENGTH, slots_a_shard: int = SLOTS_A_SHARD) -> None:
    """Write one file for each shard under ``path/shard=K``, records in the order of slots.

    Spark's own commit protocol publishes a file when its task has ended, so a lost executor's
    shards are written again by others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            records = []
            for packed in batch.column("packed").to_pylist():
                ids = expand.decompress(packed)
                records.append((len(ids) // 2).to_bytes(2, "little") + ids + bytes(2 * length - len(ids) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(records, pa.binary())], ["shard", "record"])

    shards = max(1, -(-size // slots_a_shard))
    dealt = placed.select("shard", "slot", "packed").repartitionById(shards, "shard").sortWithinPartitions("shard", "slot")
    done = dealt.select("shard", "packed").mapInArrow(run, "shard int, record binary")
    done.select("shard", F.col("record").cast("string")).write.partitionBy("shard").option("lineSep", "\n").text(path)


def training_order(docs: DataFrame, path: str, key: int = 0, length: int = LENGTH, slots_a_shard: int = SLOTS_A_SHARD, tokenizer: str | None = None) -> DataFrame:
    """Write (doc_id, text) rows as shards of token ids under ``path`` and return the index of sequences.

    Index: ``slot, shard, offset`` (bytes in its shard), ``number, first_doc_id, first_start``
    (where the sequence begins), ``n_tokens, ids_crc32`` (little-endian 16-bit ids). A null or
    empty text is its end token; repeated rows are written each; an empty table writes no shard
    and gives no rows; other columns are ignored. Slots depend on the key and on how Spark read
    the table; the shards and the index of one call agree.
    """
    cut, scratch = materialize_at(sequences(docs, tokenizer, length), "sequences")
    placed, size = in_order(cut, key, slots_a_shard)
    index = placed.select(
        "slot", "shard", ((F.col("slot") % slots_a_shard) * stride(length)).alias("offset"), "number", "first_doc_id", "first_start", "n_tokens", "ids_crc32"
    )
    index = materialize(index, "sequence-index")
    if size:
        write_shards(placed, size, path, length, slots_a_shard)
    drop_path(docs.sparkSession, scratch)
    return index


def shard_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "token-shards")
