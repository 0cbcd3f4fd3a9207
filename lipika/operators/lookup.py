"""Dictionary, override, access and next-syllable look-ups as joins; small tables are broadcast by Spark's own size check."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import scheme
from ..sources.scratch import cut, spread


def flag_dictionary(options: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, options) with ``known``: a flag for each option, in order, whether it is a word of the lexicon."""
    each = options.select("id", F.posexplode("options").alias("pos", "word"))
    words = lexicon.select("word").distinct().withColumn("hit", F.lit(True))
    flagged = each.join(words, "word", "left").select("id", "pos", "word", F.coalesce("hit", F.lit(False)).alias("known"))
    back = flagged.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "known"))).alias("o"))
    return back.select("id", F.col("o.word").alias("options"), F.col("o.known").alias("known"))


#: Characters of words and conversions that are sent to all tasks, through the driver; more are joined.
SENT_CHARS = 4_000_000
#: A word's share of all occurrences from which it counts as common. Blocks ask for a word once, so common words need no path of their own now; the name stays for callers that set it.
COMMON = 1 / 2000
#: Characters of the texts that ask for their words together; a block's different words are held at once.
BLOCK_CHARS = 8_000_000


def apply_per_distinct_word(docs: DataFrame, convert: Callable[[DataFrame], DataFrame], sent_chars: int = SENT_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Convert each distinct Latin word of (doc_id, text) rows once, lower-cased, and put the results back in place: ``doc_id, text``, a row for each row.

    ``convert`` takes a table with ``word`` and adds ``out``; a word without stays. For conversions that are dear; a
    plain column expression is cheaper applied in place. The converted words are written once and their size is
    known then: up to ``sent_chars`` they go to all tasks, which put them in place as they read the texts; beyond it blocks of texts
    ask for their different words by a join. Rows that repeat a doc_id, or have none, stay apart; a null text becomes empty.
    """
    docs = spread(docs.select("doc_id", "text"))
    found = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))
    counts = docs.select(F.explode(found).alias("run")).select(F.lower("run").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    done = cut(convert(cut(counts).select("word")).select("word", "out").where("out IS NOT NULL"))
    size = done.agg(F.sum(F.char_length("word") + F.char_length("out"))).first()[0] or 0
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text string"
    if size <= sent_chars:
        sent = docs.sparkSession.sparkContext.broadcast({r["word"]: r["out"] for r in done.collect()})
        return docs.mapInArrow(lambda batches: _put_back(batches, sent.value), schema)
    # texts and words of a block come from one reading; a word stands at most once in a block, so common ones are no heavy keys
    asked = docs.mapInArrow(lambda batches: _ask(batches, block_chars), f"block long, asked string, word string, {schema}")
    met = asked.join(done.select(F.col("word").alias("found"), "out"), F.col("asked") == F.col("found"), "left").select("block", "word", "out", "doc_id", "text")
    return met.repartition("block").sortWithinPartitions("block", F.col("word").asc_nulls_last()).mapInArrow(_put_back_blocks, schema)


_WORD = re.compile("[a-zA-Z]+")


def _filled(text: str | None, table: dict[str, str]) -> str:
    return _WORD.sub(lambda m: table.get(m[0].lower(), m[0]), text or "")


def _put_back(batches: Iterator[pa.RecordBatch], table: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Texts with each word's conversion in its place."""
    for batch in batches:
        texts = [_filled(text, table) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _ask(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[pa.RecordBatch]:
    """A task's rows, each with its block, and each block's different words, lower-cased, in rows of their own."""
    names = ["block", "asked", "word", "doc_id", "text"]
    block, held, words = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0, set()

    def asked(of: set[str], ids: pa.DataType) -> pa.RecordBatch:
        own = pa.array(list(of), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), own, own, pa.nulls(len(own), ids), pa.nulls(len(own), pa.string())], names)

    for batch in batches:
        texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").type
        start = 0
        for k, text in enumerate(texts, 1):
            words.update(map(str.lower, _WORD.findall(text or "")))
            held += len(text or "")
            if k == len(texts) or held >= block_chars:
                rows = batch.slice(start, k - start)
                # texts meet no word; what they are joined by spreads them
                nothing = pa.array([f" {(block + at) % 4096}" for at in range(start, k)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), nothing, pa.nulls(len(rows), pa.string()), rows.column("doc_id"), rows.column("text")], names)
                start = k
            if held >= block_chars:
                yield asked(words, ids)
                block, held, words = block + 1, 0, set()
    if words:
        yield asked(words, ids)


def _put_back_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each word's conversion in its place, of rows by block, its words before its texts."""
    present, table = None, {}
    for batch in batches:
        texts = []
        for block, word, out, text in zip(*(batch.column(c).to_pylist() for c in ("block", "word", "out", "text")), strict=True):
            if block != present:
                present, table = block, {}
            if word is None:
                texts.append(_filled(text, table))
            elif out is not None:
                table[word] = out
        rows = batch.filter(batch.column("word").is_null())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def apply_overrides(suggestions: DataFrame, overrides: DataFrame) -> DataFrame:
    """(latin, options): a spelling with an override gets that override's first option first."""
    first = overrides.select(F.col("latin").alias("key"), F.try_element_at("options", F.lit(1)).alias("over"))
    joined = suggestions.join(first, F.lower("latin") == F.col("key"), "left")
    return joined.select("latin", F.when(F.col("over").isNull(), F.col("options")).otherwise(F.concat(F.array("over"), F.array_remove("options", F.col("over")))).alias("options"))


def override_options(suggestions: DataFrame, overrides: DataFrame, k: int = 4) -> DataFrame:
    """(latin, options): the first ``k`` options, which are an override's alone where the spelling has one."""
    own = overrides.select(F.col("latin").alias("key"), F.col("options").alias("over"))
    joined = suggestions.join(own, F.lower("latin") == F.col("key"), "left")
    return joined.select("latin", F.slice(F.coalesce("over", "options"), 1, k).alias("options"))


def exact_dict_first(words: DataFrame, pron: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words with a dictionary pronunciation (with it), and those left for the model."""
    return words.join(pron, "word"), words.join(pron, "word", "left_anti")


def clash_flags(words: DataFrame, english: DataFrame, clash: DataFrame) -> DataFrame:
    """Add ``english`` and ``clash``: whether the word is in either list."""
    e = english.select("word").distinct().withColumn("english", F.lit(True))
    c = clash.select("word").distinct().withColumn("clash", F.lit(True))
    return words.join(e, "word", "left").join(c, "word", "left").na.fill(False, ["english", "clash"])


def authorize(requests: DataFrame, api_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose key may use their language, and all others (null keys too)."""
    return requests.join(api_keys, ["key", "lang"], "left_semi"), requests.join(api_keys, ["key", "lang"], "left_anti")


def next_options(states: DataFrame, table: DataFrame, lang: str) -> DataFrame:
    """(id, typed, key) with the last syllable typed (``prev``), the key's grid (``simple``), the compounds after prev
    (``compound``; null where the table has none), and whether a joiner may follow."""
    last = F.coalesce(F.try_element_at(scheme.aksharas(F.col("typed"), lang), F.lit(-1)), F.lit("^"))
    placed = states.withColumn("prev", last)
    compound = table.where("prev <> '#'").select("prev", "key", F.col("entries").alias("compound"))
    grid = table.where("prev = '#'").select("key", F.col("entries").alias("simple"))
    joiner = placed["prev"].endswith(R.halanth(lang)) & F.lit(R.LANGUAGES[lang].zwnj_significant)
    return placed.join(compound, ["prev", "key"], "left").join(grid, "key", "left").select("id", "typed", "key", "prev", "simple", "compound", joiner.alias("joiner"))


def joiner_variants(prefix: Column, suffix: Column, lang: str) -> Column:
    """The plain join, and with each joiner between that the language tells apart, if a consonant follows."""
    of = R.LANGUAGES[lang]
    marks = [mark for mark, significant in (("\u200d", of.zwj_significant), ("\u200c", of.zwnj_significant)) if significant]
    plain = F.concat(prefix, suffix)
    opens = suffix.rlike("^" + R.code_class(lang, R.CONS))
    return F.when(opens, F.array(plain, *[F.concat(prefix, F.lit(m), suffix) for m in marks])).otherwise(F.array(plain))


def encode_symbols(symbols: Column, codes: dict[str, str]) -> Column:
    """Codes of the symbols joined, and their number; a word with an unknown symbol stays as it is, with -1."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    coded = F.transform(symbols, lambda s: F.try_element_at(table, s))
    bad = F.exists(coded, lambda c: c.isNull())
    return F.struct(F.array_join(F.when(bad, symbols).otherwise(coded), "").alias("word"), F.when(bad, -1).otherwise(F.size(symbols)).alias("n"))
