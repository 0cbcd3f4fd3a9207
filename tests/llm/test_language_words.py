"""Language identification, spelling variants and phrase mining against plain loops, with odd inputs."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lipika.llm import language, phrases, q11_language, q12_variants, variants

# 11 -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(language.piece_path())


def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=language.piece_path())
    return {model.id_to_piece(k): k for k in range(model.get_piece_size()) if not model.is_control(k) and not model.is_unknown(k)}


def segmentations(word, known):
    """All ways to cut a word into pieces, as lists of piece numbers; a character that is no piece is read as its bytes."""
    symbols = []
    for c in "▁" + word:
        symbols += [c] if c in known else [f"<0x{b:02X}>" for b in c.encode()]

    def cut(k):
        if k == len(symbols):
            yield []
        for n in range(1, len(symbols) - k + 1):
            own = symbols[k : k + n]
            name = own[0] if n == 1 else "".join(own) if all(len(s) == 1 for s in own) else None
            if name in known:
                for rest in cut(k + n):
                    yield [known[name], *rest]

    return list(cut(0))


def test_all_segmentations_are_summed(pieces):
    known, rng = vocabulary(), np.random.default_rng(1)
    p = rng.random((pieces.size, 3)) ** 4
    words = ["the", "a", "überall", "été", "station", "\U00013000a", "x\U00013000", "zzzz", "in", "the"]
    got = pieces.log_chances(words, p)
    want = [[math.log(sum(math.prod(p[k, j] for k in way) for way in segmentations(w, known))) for j in range(3)] for w in words]
    assert np.allclose(got, want)
    langs, n = np.array([k % 3 for k in range(len(words))]), np.arange(1.0, len(words) + 1)
    counts = np.zeros_like(p)
    for w, lang, m in zip(words, langs, n, strict=True):
        ways = segmentations(w, known)
        weight = [math.prod(p[k, lang] for k in way) for way in ways]
        for way, x in zip(ways, weight, strict=True):
            for k in way:
                counts[k, lang] += m * x / sum(weight)
    assert np.allclose(pieces.expected(words, langs, n, p), counts)
    assert pieces.log_chances([], p).shape == (0, 3) and pieces.expected([], langs[:0], n[:0], p).sum() == 0


def test_long_words_do_not_vanish(pieces):
    p = np.full((pieces.size, 1), 1e-7)
    long = "ab" * 4000
    logs = [0.0]
    known = vocabulary()
    text = "▁" + long
    for j in range(1, len(text) + 1):
        logs.append(np.logaddexp.reduce([logs[i] + math.log(1e-7) for i in range(max(0, j - pieces.longest), j) if text[i:j] in known]))
    assert np.isclose(pieces.log_chances([long], p)[0, 0], logs[-1])
    counts = pieces.expected([long], np.array([0]), np.array([2.0]), p)
    assert np.isfinite(counts).all() and 2 * len(text) / pieces.longest <= counts.sum() <= 2 * len(text)


SPEECH = {"en": ["the", "and", "tion", "ing", "wh"], "de": ["der", "sch", "ung", "ich", "ö"], "हिं": ["का", "में", "है", "नहीं"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SPEECH[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_match_a_plain_loop_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, spoken(rng, lang := rng.choice(list(SPEECH)), rng.randint(1, 12)), lang) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit_language(docs.select("text", "lang"))
    known, langs = vocabulary(), sorted(SPEECH)
    assert model.langs == tuple(langs)
    counts = collections.Counter((lang, w) for _, text, lang in rows for w in re.findall(r"[^\W\d_]+", text.lower()))
    ways = {w: segmentations(w, known) for _, w in counts}
    p = {lang: collections.defaultdict(lambda: 1.0 / 32000) for lang in langs}
    for _ in range(language.ROUNDS):
        sums = {lang: collections.Counter() for lang in langs}
        for (lang, w), n in counts.items():
            weight = [math.prod(p[lang][k] for k in way) for way in ways[w]]
            for way, x in zip(ways[w], weight, strict=True):
                for k in way:
                    sums[lang][k] += n * x / sum(weight)
        for lang in langs:
            total = sum(sums[lang].values())
            p[lang] = collections.defaultdict(lambda: 0.01 / 32000, {k: 0.99 * n / total + 0.01 / 32000 for k, n in sums[lang].items()})
    got = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    for k, text, _ in rows:
        logs = [sum(math.log(sum(math.prod(p[lang][x] for x in way) for way in ways[w])) for w in re.findall(r"[^\W\d_]+", text.lower())) for lang in langs]
        best = max(range(len(langs)), key=lambda j: logs[j])
        assert got[k]["lang_pred"] == langs[best] and abs(got[k]["score"] - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-6
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 ²² ...", "x"), (None, "THE WHING", "x"), (5, "the", "x"), (5, "the", "x"), (6, "der " * 200_000, "x")], "doc_id long, text string, lang_pred string")
    found = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in language.identify_language(odd, model, chunk_words=50).collect()))
    assert found == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "en"), (5, "en"), (6, "de")]
    assert language.identify_language(odd.limit(0), model).count() == 0
    nothing = language.fit_language(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert {(r["lang_pred"], r["score"]) for r in language.identify_language(odd, nothing).collect()} == {("und", 0.0)}
    same = language.LanguageModel(model.path, ("a", "b"), np.repeat(model.chances[:, :1], 2, axis=1))
    assert {r["lang_pred"] for r in language.identify_language(docs, same).collect()} == {"a"}


def test_language_query_holds_documents_out(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, spoken(rng, lang := rng.choice(["en", "de"]), 20), lang if k % 7 else None) for k in range(200)] + [(None, "the", "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in q11_language.query(spark, str(tmp_path)).collect()}
    held = {k for k, *_ in rows if k is not None and zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, r in got.items() if r["held_out"]} == held and len(got) == 201 and not got[None]["held_out"]
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows if lang in ("en", "de"))


# 12 -----------------------------------------------------------------------------------------------


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one word the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(counts, ratio=2):
    forms, n_near = {}, {}
    for w, n in counts.items():
        beside = [v for v in counts if near(v, w)]
        n_near[w] = len(beside)
        best = min(beside, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n, n_near[w], counts[forms[w]] if forms[w] is not None else None))
    return out


@pytest.mark.parametrize("part_words", [4, 10_000])
def test_variants_match_brute_force(spark, part_words):
    rng = random.Random(part_words)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 2, 3, 5, 9, 20, 41]) for _ in range(250)}
    counts |= {"aaaa": 7, "aaaaa": 3, "aaaaaa": 1, "ÿ" * 40: 9, "ÿ" * 41: 4, "b" * 3000: 2, "b" * 2999 + "a": 5}
    rows = spark.createDataFrame([*counts.items(), (None, 3), ("", 5)], "word string, n long").withColumn("id", F.lit("clash")).repartition(3)
    got = {tuple(r) for r in variants.variants(rows, part_words=part_words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(counts)


def test_chains_of_forms_end_at_their_last_word(spark):
    counts = {"a" * (20 - k) + "b" * k: 2**k for k in range(20)}
    got = {r["word"]: r["root"] for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" + "b" * 19}
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="more frequent"):
        variants.variants(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_variants_query_on_texts(spark, tmp_path):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice([x, x.upper(), x + "1", "-" + x + "×y"]) for x in rng.choices(names, k=rng.randint(0, 60))) for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, texts[3]), (81, None), (82, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = collections.Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = plain_variants({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = {tuple(r) for r in q12_variants.query(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == want and len(want) > 40


# 13 -----------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top, longest=5):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if 2 <= len(g) <= longest and c >= least}
        held = {g[i:j] for g in cand for i, j in itertools.combinations(range(len(g) + 1), 2) if 2 <= j - i < len(g) and cand[g] >= f[g[i:j]]}
        scored = []
        for g, a in cand.items():
            if g not in held:
                score, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, k, w.decode(), -a, left, right, n, -s) for k, (s, a, w, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_words", [3, 100_000])
def test_phrases_match_brute_force(spark, block_words):
    rng = random.Random(4)
    words = ["a", "B", "c", "é", "D\x00", "the", "x y", "ab"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " ! "]) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "de", None]), text))
    rows += [("en", None), ("en", ""), (None, ""), ("fr", "..."), ("en", "the a the a the a " * 300), ("en", "the b c d e f")] + [("en", "the b c d e")] * 4
    docs = spark.createDataFrame([(lang, t, 1, "x") for lang, t in rows], "lang string, text string, total long, id string").repartition(4)
    for least, top in ((3, 1000), (4, 7)):
        got = phrases.phrases(docs, least=least, top=top, block_words=block_words)
        want = plain_phrases(rows, least, top)
        assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == want and len(want) > 10
    assert phrases.phrases(docs.limit(0), block_words=block_words).count() == 0
    assert phrases.phrases(docs, least=10**6, block_words=block_words).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, left, right = 9_007_199_254_740_993, 9_223_372_036_854_775_807, 3_000_000_019, 2**61 - 1
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(phrases._score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first()
    assert int(row["s"]) == 1000 * a * n // (left * right)
