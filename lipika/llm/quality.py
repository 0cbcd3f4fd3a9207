"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` bytes are max-pooled in overlapping chunks that cover the whole text; a
hidden layer reads each chunk's pooled filters; its units are max-pooled over all chunks and
combined into one probability. Bytes enter through a learned embedding, which is folded into the
filters for use, so a filter is a sum of table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half a chunk: chunks of twice this many bytes begin every this many.
HALF = 128
WIDTH = 5
EMBED = 8
FILTERS = 16
HIDDEN = 16
#: Labelled rows the network is fitted on, at most, and the bytes of the longest text among them.
TRAIN_ROWS, TRAIN_BYTES = 2_500, 100_000
EPOCHS = 6
#: Bytes that go through the filters at once.
BLOCK = 1 << 16
SEED = 11


class ByteConvNet:
    """The network; ``fit`` learns it by back-propagation (Adam), ``scores`` applies it to whole texts."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "embed": normal(257, EMBED, scale=0.5),  # 256: past the end
            "filters": normal(WIDTH, EMBED, FILTERS, scale=0.3),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS + 1, HIDDEN, scale=0.3),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=0.3),
            "out_bias": np.zeros(1, np.float32),
        }

    @classmethod
    def blank(cls) -> ByteConvNet:
        """A network that knows nothing: every text's score is one half."""
        net = cls()
        net.p["out"][:] = 0
        return net

    def _tables(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.p["embed"], self.p["filters"])

    def _padded(self, text: bytes) -> np.ndarray:
        """The text's bytes to a whole number of halves, two at least, and what the last window looks ahead."""
        size = max(2, -(-len(text) // HALF)) * HALF + WIDTH - 1
        out = np.full(size, 256, np.int16)
        out[: len(text)] = np.frombuffer(text, np.uint8)
        return out

    def _halves(self, data: np.ndarray, tables: np.ndarray, where: bool = False):
        """Each filter's largest value in every half chunk, and where it stands."""
        n = len(data) - WIDTH + 1
        tops, places = [], []
        for a in range(0, n, BLOCK):
            size = min(BLOCK, n - a)
            total = tables[0][data[a : a + size]]
            for k in range(1, WIDTH):
                total += tables[k][data[a + k : a + k + size]]
            cut = total.reshape(-1, HALF, FILTERS)
            if where:
                at = cut.argmax(1)
                places.append(at + a + HALF * np.arange(len(cut))[:, None])
                tops.append(np.take_along_axis(cut, at[:, None], 1)[:, 0])
            else:
                tops.append(cut.max(1))
        return (np.concatenate(tops), np.concatenate(places)) if where else np.concatenate(tops)

    def _chunks(self, halves: np.ndarray, size: int) -> np.ndarray:
        pooled = np.maximum(np.maximum(halves[:-1], halves[1:]) + self.p["bias"], 0)
        filled = np.clip((size - HALF * np.arange(len(pooled))) / (2 * HALF), 0, 1)
        return np.concatenate([pooled, filled[:, None].astype(np.float32)], 1)

    def logit(self, text: bytes, tables: np.ndarray) -> float:
        chunks = self._chunks(self._halves(self._padded(text), tables), len(text))
        units = np.maximum(chunks @ self.p["hidden"] + self.p["hidden_bias"], 0).max(0)
        return float(units @ self.p["out"] + self.p["out_bias"][0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        tables = self._tables()
        logits = np.array([self.logit(t, tables) for t in texts])
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def _gradient(self, text: bytes, label: int, tables: np.ndarray, g: dict[str, np.ndarray]) -> None:
        p, data = self.p, self._padded(text)
        halves, places = self._halves(data, tables, where=True)
        chunks = self._chunks(halves, len(text))
        raw = chunks @ p["hidden"] + p["hidden_bias"]
        best = raw.argmax(0)  # the chunk each unit is taken from
        units = np.maximum(raw[best, np.arange(HIDDEN)], 0)
        error = 1 / (1 + np.exp(-float(units @ p["out"] + p["out_bias"][0]))) - label
        g["out"] += error * units
        g["out_bias"] += error
        d_units = error * p["out"] * (units > 0)
        g["hidden_bias"] += d_units
        g["hidden"] += chunks[best].T * d_units
        d_pool = (p["hidden"][:-1] * d_units).T * (chunks[best, :-1] > 0)  # unit, filter
        g["bias"] += d_pool.sum(0)
        later = halves[best] < halves[best + 1]
        at = np.where(later, places[best + 1], places[best])  # unit, filter: place of the winning window
        for k in range(WIDTH):
            seen = p["embed"][data[at + k]]
            g["filters"][k] += np.einsum("uf,ufe->ef", d_pool, seen)
            np.add.at(g["embed"], data[at + k], d_pool[..., None] * p["filters"][k].T[None])

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01) -> ByteConvNet:
        rng = np.random.default_rng(SEED)
        share = min(max(np.mean(labels), 0.01), 0.99) if labels else 0.5
        self.p["out_bias"][0] = np.log(share / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, steps = 0, max(1, epochs * -(-len(texts) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                own, tables = order[a : a + batch], self._tables()
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                for i in own:
                    self._gradient(texts[i], labels[i], tables, g)
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k in self.p:
                    d = g[k] / len(own) + 1e-4 * self.p[k]
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def learning_fold(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` labelled learning rows of at most ``TRAIN_BYTES``, drawn by a hash of the id: a bounded sample for the driver.

    Documents of one id share their largest label, and the least of their texts is learned.
    """
    known = labels.where(F.col(label).isNotNull() & learning_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    found = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in found], [int(r["label"]) for r in found]


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ByteConvNet:
    """The network fitted on a bounded sample of labelled documents; without any it gives every text one half.

    Labels that are null or of held-out rows are not read.
    """
    texts, marks = labelled_sample(docs, labels, "quality", rows)
    return ByteConvNet().fit(texts, marks) if texts else ByteConvNet.blank()


def score_quality(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) to rows with a ``text``, from the whole text's bytes alone.

    A null text scores as the empty one. Repeated rows score alike; an empty table stays empty;
    a former ``score`` column is replaced, others pass through. No shuffle.
    """
    weights = net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ByteConvNet()
        own.p = weights
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = own.scores([(t or "").encode() for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    docs = docs.drop("score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
