"""The pipeline's stages in order, each against what its operator must do."""

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_ops import brute_components, brute_contaminated, near_copies, text_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = near_copies(rng, 150)
    rows += [(500 + k, text_of(rng, 60).replace(" ", "%%% ")) for k in range(80)]
    items = [(k, text_of(rng, 25)) for k in range(4)]
    rows += [(700 + k, text_of(rng, 30) + " " + items[k][1] + " " + text_of(rng, 30)) for k in range(4)]
    rows = [(d, "menu line here\n" + t if d % 2 else t) for d, t in rows]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, 0 if 500 <= d < 600 else 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicate removal", "benchmark decontamination", "packing"]
    now, kept = docs, {d: t for d, t in rows}
    for name, stage in pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == list(pipeline.COLUMNS)
            out.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            after = {r["doc_id"]: r["text"] for r in now.collect()}
            assert now.where(F.col("n_chars") != F.char_length("text")).count() == 0
        if name == "quality classifier":
            assert after.items() <= kept.items()
            assert sum(500 <= d < 600 for d in after) <= 4 and sum(not 500 <= d < 600 for d in after) >= 0.97 * 154
        elif name == "line dedup":
            assert after == {d: t.removeprefix("menu line here\n") for d, t in kept.items()}
        elif name == "near-duplicate removal":
            groups = brute_components(list(kept.items()))
            assert set(after) == {d for d, c in groups.items() if d == c}
        elif name == "benchmark decontamination":
            assert set(after) == {d for d, t in kept.items() if not brute_contaminated(t, items)} and len(after) < len(kept)
        else:
            assert {r["doc_id"] for r in out.collect()} == set(kept)
        kept = after
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert collections.Counter(c for c in pipeline.COLUMNS) == collections.Counter(docs.columns)
