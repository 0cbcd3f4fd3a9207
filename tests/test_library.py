"""Golden rows and properties of the library's operators."""

import collections
import datetime as dt
import itertools
import json
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lipika.functions import letters, phonemes, scheme, text
from lipika.operators import counters, lexicon, lookup, predict, ranking, romanize, trees
from lipika.plans import jobs, queries
from lipika.sources import tables
from lipika.streaming import words as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scheme_goldens(spark):
    cases = {"rAShTrapati": "राष्ट्रपति", "oum": "ॐ", ".c": "", "ka-ki": "क-कि", "k": "क", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "w string").select("w", scheme.scheme_to_script(F.col("w"), "hindi").alias("x")).collect()
    assert {r["w"]: r["x"] for r in rows} == cases
    a, b = (one(spark, scheme.scheme_to_script(F.lit(w), "hindi")) for w in ("raaj/kumaar", "raaj.h^^kumaar"))
    assert a == b == "राज्\u200cकुमार"
    assert one(spark, scheme.scheme_to_script(F.lit("k"), "kannada")) == "ಕ್"


def test_syllables_and_back(spark):
    words = spark.createDataFrame([("राष्ट्रपति",), ("कंप्यूटर",), ("abc",), ("राम",), ("आई",)], "w string")
    rows = {r["w"]: r for r in words.select("w", scheme.aksharas(F.col("w"), "hindi").alias("a"), scheme.script_to_scheme(F.col("w"), "hindi").alias("s")).collect()}
    assert rows["राष्ट्रपति"]["a"] == ["रा", "ष्ट्र", "प", "ति"]
    assert rows["कंप्यूटर"]["a"] == ["क", "प्यू", "ट", "र"]
    assert rows["abc"]["a"] == []
    assert rows["राम"]["s"] == ["rAm", "raam"]
    assert rows["आई"]["s"] == ["A/I", "aa/ii", "aa/ee"]
    spelled = words.where("w <> 'abc'").select("w", F.explode(scheme.script_to_scheme(F.col("w"), "hindi")).alias("s"))
    assert spelled.where(scheme.scheme_to_script(F.col("s"), "hindi") != F.col("w")).count() == 0
    assert [r["s"] for r in spelled.where("w = 'राष्ट्रपति'").collect()] == ["rAShTrapati", "raaSHTrapati"]


def test_text_goldens(spark):
    assert [one(spark, text.preprocess(F.lit(w))) for w in ("cycle", "cch", "Boo", "hum")] == ["sykle", "kch", "bU", "ham"]
    assert one(spark, text.split_runs(F.lit("a1 b--c"))) == ["a", "1 ", "b", "--", "c"]
    assert one(spark, text.strip_stress(F.lit("aa1 ow0 ow2 t"))) == "aa ow ow1 t"
    assert one(spark, text.clean_pronunciation(F.lit("k_er#-t"))) == "k ah r - t"
    options = lambda *rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    assert one(spark, text.expand_options(options("ab", "x", "pq"))) == ["axp", "bxp", "axq", "bxq"]
    assert one(spark, text.expand_options(options(*["ab"] * 7))) == ["a" * 7]


def test_markup(spark):
    rows = spark.createDataFrame([(1, r"hello \hindi raam \itrans{rAShTrapati} \english bye"), (2, r"\\hindi raam")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in jobs.render_markup(rows).collect()}
    assert out == {1: "hello  raam राष्ट्रपति  bye", 2: r"\hindi raam"}


def test_markup_is_compiled(spark):
    """No stage's code is too large, whatever languages the marks may name."""
    text = F.concat(F.lit(r"\hindi raam \itrans{raama}\tamil \itrans{maram} x"), F.col("id").cast("string"))
    tree = jobs.train_language(spark.createDataFrame([("राम",)], "word string"), "hindi").cache()
    tree.count()
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        out = {r["doc_id"]: r["text"] for r in jobs.render_markup(spark.range(2).select(F.col("id").alias("doc_id"), text.alias("text")), models={"hindi": tree}).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert out == {k: f" राम राम மரம் x{k}" for k in range(2)}


def test_transliterate_text(spark):
    rows = spark.createDataFrame([(1, "raam, 2 kumaar!"), (2, ""), (3, "123"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in jobs.transliterate_text(rows, "hindi").collect()} == {1: "राम, 2 कुमार!", 2: "", 3: "123", 4: ""}
    convert = lambda words: words.withColumn("out", scheme.scheme_to_script(F.col("word"), "hindi"))
    slow = lookup.apply_per_distinct_word(rows.where("text is not null"), convert)
    assert {r["doc_id"]: r["text"] for r in slow.collect()} == {1: "राम, 2 कुमार!", 2: "", 3: "123"}


def test_ranking(spark):
    five = F.array(*[F.lit(f"o{k}") for k in range(5)])
    place = lambda c, e, k: one(spark, ranking.insert_sound_candidate(five, F.lit(c), F.lit(e), F.lit(k)))
    assert place("c", True, True) == ["o0", "c", "o1", "o2", "o3", "o4"]
    assert place("o2", True, False) == ["o2", "o0", "o1", "o3", "o4"]
    assert place("c", False, False) == ["o0", "o1", "o2", "c", "o3", "o4"]
    assert place("o3", False, False) == ["o0", "o1", "o2", "o3", "o4"]
    known = F.array(F.lit(False), F.lit(True), F.lit(False), F.lit(True))
    assert one(spark, ranking.dictionary_first(F.array(*map(F.lit, "xyzw")), known)) == ["y", "w", "x", "z"]


def test_log_normalize(spark):
    rows = spark.createDataFrame([("k", "p", "a", True, n) for n in (100, 10, 1)] + [("k", "q", c, True, 1) for c in "ab"], "key string, prev string, akshara string, simple boolean, n long")
    scores = {(r["prev"], r["n"], r["akshara"]): r["score"] for r in lexicon.log_normalize(rows).collect()}
    assert scores == {("p", 100, "a"): 10.0, ("p", 10, "a"): 5.0, ("p", 1, "a"): 0.0, ("q", 1, "a"): 0.0, ("q", 1, "b"): 0.0}


def test_authorize(spark):
    requests = spark.createDataFrame([(1, "k1", "hindi"), (2, "k2", "tamil"), (3, None, "hindi")], "req_id long, key string, lang string")
    keys = spark.createDataFrame([("k1", "hindi"), ("k1", "tamil"), ("k2", "hindi")], "key string, lang string")
    yes, no = lookup.authorize(requests, keys)
    assert [r["req_id"] for r in yes.collect()] == [1]
    assert sorted(r["req_id"] for r in no.collect()) == [2, 3]


# The letter t in fifteen words, where it stands, and whether it is retroflex.
DEMO = [
    ("topi", 0, "ಟ"),
    ("pata", 2, "ಟ"),
    ("tande", 0, "ತ"),
    ("hosatu", 4, "ತ"),
    ("hosatana", 4, "ತ"),
    ("vasati", 4, "ತ"),
    ("vasanta", 5, "ತ"),
    ("tagaru", 0, "ಟ"),
    ("takadi", 0, "ತ"),
    ("vata", 2, "ಟ"),
    ("rata", 2, "ತ"),
    ("virata", 4, "ಟ"),
    ("viratanagara", 4, "ಟ"),
    ("rajavirata", 8, "ಟ"),
    ("rati", 2, "ತ"),
]
# Groups of letters that the trees may ask for.
DEMO_GROUPS = [
    ("vowel", ["a", "e", "i", "o", "u", "y"]),
    ("G1", ["k", "K", "g", "G", "c", "C", "j", "J", "t", "T", "d", "D", "n", ""]),
    ("G2", ["p", "f", "b", "B", "m"]),
    ("G3", ["y", "r", "l", "v", "w", "S", "s", "h"]),
    ("cons", ["k", "K", "g", "G", "c", "C", "j", "J", "t", "T", "d", "D", "n", "", "p", "f", "b", "B", "m", "y", "r", "l", "v", "w", "S", "s", "h"]),
]


def plain_tree(rows, groups, node=""):
    """Node by node as the rules say: rows are (marked window, offset, class, count)."""
    counts = collections.Counter()
    for _, _, c, n in rows:
        counts[c] += n
    total = sum(counts.values())
    best, chosen = round(sum(n * n for n in counts.values()) / total**2, 12), None
    for d in (0, -1, 1, -2, 2, -3, 3, -4, 4):
        for label, literals in groups:
            hit = [any(x and 0 <= o + d < len(w) and w[o + d :].startswith(x) for x in literals) for w, o, *_ in rows]
            sides = [collections.Counter(), collections.Counter()]
            for (_, _, c, n), h in zip(rows, hit, strict=True):
                sides[not h][c] += n
            if sides[0] and sides[1]:
                score = round(sum(sum(n * n for n in s.values()) / sum(s.values()) for s in sides) / total, 12)
                if score > best:
                    best, chosen = score, (d, label, hit)
    if chosen is None:
        return {node: (None, None, sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    d, label, hit = chosen
    parts = [[r for r, h in zip(rows, hit, strict=True) if h == side] for side in (True, False)]
    return {node: (d, label, None)} | plain_tree(parts[0], groups, node + "0") | plain_tree(parts[1], groups, node + "1")


def grown(spark, rows, groups):
    examples = spark.createDataFrame([("t", *r) for r in rows], "key string, window string, offset int, cls string, n long")
    tree = trees.grow(examples, groups)
    return examples, tree, {r["node"]: (r["delta"], r["feature"], r["classes"] and [tuple(c) for c in r["classes"]]) for r in tree.collect()}


def test_demo_tree_node_by_node(spark, monkeypatch):
    rows = [(("#" + w + "_")[max(0, k - 3) : k + 6], k + 1 - max(0, k - 3), c, 1) for w, k, c in DEMO]
    singles = [(c, [c]) for c in sorted({c for w, *_ in rows for c in w})]
    want = plain_tree(rows, [*DEMO_GROUPS, *singles])
    for small in (1000, 8):  # by one task, and level by level
        monkeypatch.setattr(trees, "NODE_BYTES", small * 950)  # some 930 bytes an example
        examples, tree, got = grown(spark, rows, DEMO_GROUPS)
        assert got == want
        for most in (1000, 0):  # by a model sent to the tasks, and joined level by level
            found = trees.predict(examples, tree, most)
            assert found.where(F.col("classes")[0]["cls"] != F.col("cls")).count() == 0 and found.where("classes IS NULL").count() == 0
    assert max(map(len, want)) >= 3
    unknown = trees.predict(spark.createDataFrame([("x", "#soti_", 3), (None, None, None)], "key string, window string, offset int"), tree)
    assert unknown.count() == 2 and unknown.where("classes IS NOT NULL").count() == 0


def test_rows_go_down_trees_together_as_they_do_one_by_one(spark):
    rng = random.Random(6)
    named = {"a": ["a"], "long": ["kha", "b", "\U0001F600"], "any": [""], "none": [], "end": ["_"]}
    nodes: dict[tuple[str, str], tuple] = {}

    def below(key: str, node: str) -> None:
        if len(node) == 5 or (node and rng.random() < 0.2):
            nodes[key, node] = (None, None, None, [(f"{key}{node}", 1)])
            return
        label = rng.choice(sorted(named))
        nodes[key, node] = (rng.randint(-3, 3), label, named[label], None)
        below(key, node + "0")
        below(key, node + "1")

    for key in ("k", "a"):
        below(key, "")
    nodes["l", ""] = (None, None, None, [("leaf", 2)])
    tree = spark.createDataFrame([(*k, *v) for k, v in nodes.items()], trees.TREE)
    rows = [(rng.choice("kalx"), "#" + "".join(rng.choice(["k", "h", "a", "b", "\U0001F600", "z"]) for _ in range(rng.randint(0, 7))) + "_", rng.randint(0, 8)) for _ in range(500)]
    found = {(r["key"], r["window"], r["offset"]): r["classes"] and r["classes"][0]["cls"] for r in trees.predict(spark.createDataFrame(rows, "key string, window string, offset int"), tree).collect()}
    for key, window, offset in rows:
        node, own = "", nodes.get((key, ""))
        while own is not None and own[0] is not None:
            start = offset + own[0]
            node += "0" if 0 <= start < len(window) and any(window.startswith(x, start) for x in own[2]) else "1"
            own = nodes[key, node]
        assert found[key, window, offset] == (own and own[3][0][0])
    table = trees._Model(tree)  # no object for each node reaches the tasks
    assert not [k for k, v in vars(table).items() if isinstance(v, dict | list) and len(v) > len(named)]
    assert trees.predict(spark.createDataFrame(rows, "key string, window string, offset int"), tree.limit(0)).where("classes IS NOT NULL").count() == 0


def test_trees_of_any_depth_hold_all_examples(spark, monkeypatch):
    rng = random.Random(3)
    letters_of = [chr(0x4E00 + k) for k in range(90)]
    # one letter after another decides, so that the tree is a chain of some 90 nodes
    rows = [("#" + "t" + c + "_", 1, f"c{k:02d}", 2 ** (k // 3)) for k, c in enumerate(letters_of)]
    rng.shuffle(rows)
    for small in (1000, 87):
        monkeypatch.setattr(trees, "NODE_BYTES", small * 950)  # some 930 bytes an example
        examples, tree, got = grown(spark, rows, [])
        assert sum(n for _, _, own in got.values() if own for _, n in own) == sum(r[3] for r in rows)
        assert max(map(len, got)) > 64
        assert trees.predict(examples, tree).where(F.col("classes")[0]["cls"] == F.col("cls")).count() == len(rows)


def test_groups_with_long_literals_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    groups = [("aspirated", ["kh", "th", "dh"]), ("vowel", ["a", "i", "u"]), ("kha", ["kha", "k"])]
    rows = collections.Counter()
    for _ in range(60):
        w = "#" + "".join(rng.choice(["kh", "t", "th", "a", "i", "dh", "k", "u"]) for _ in range(rng.randint(1, 5))) + "_"
        k = rng.randrange(1, len(w) - 1)
        rows[w, k, rng.choice("AB")] += rng.randint(1, 3)
    rows = [(*r, n) for r, n in rows.items()]
    want = plain_tree(rows, [*groups, *((c, [c]) for c in sorted({c for w, *_ in rows for c in w}))])
    for small in (1000, 40):
        monkeypatch.setattr(trees, "NODE_BYTES", small * 950)  # some 930 bytes an example
        assert grown(spark, rows, groups)[2] == want


def test_counts_by_the_smaller_child(spark, monkeypatch):
    rng = random.Random(6)
    windows = {}
    for _ in range(80):
        w, k = "#" + "".join(rng.choices("abcde", k=5)) + "_", rng.randrange(1, 6)
        windows[w, k, "XXYYZ"["abcde".index(w[k])]] = rng.randint(1, 9)
    examples = spark.createDataFrame([("t", w, k, c, n, "1" if "a" in w else "0") for (w, k, c), n in windows.items()], "key string, window string, offset int, cls string, n long, node string")
    counts = trees.split_counts(examples, [("a", ["a"]), ("bc", ["b", "c"])])
    parents = trees.split_counts(examples.withColumn("node", F.lit("")), [("a", ["a"]), ("bc", ["b", "c"])])
    for smaller, larger in ("01", "10"):
        pairs = spark.createDataFrame([("t", "", smaller, larger)], "key string, parent string, smaller string, larger string")
        got = trees.sibling_counts(parents, counts.where(F.col("node") == smaller), pairs)
        want = counts.where(F.col("node") == larger)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # the larger child stays large for some levels
    rows = [(w, k, c, n) for (w, k, c), n in windows.items()]
    want = plain_tree(rows, [(c, [c]) for c in sorted({c for w, *_ in rows for c in w})])
    monkeypatch.setattr(trees, "NODE_BYTES", 40 * 950)
    assert grown(spark, rows, [])[2] == want


def test_a_thousand_classes_in_bounded_memory(monkeypatch):
    rng = random.Random(7)
    windows = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(7)) for _ in range(6000)]
    classes, n = np.array([rng.randrange(1000) for _ in windows]), np.array([float(rng.randint(1, 5)) for _ in windows])
    tree = trees._Subtree(windows, [3] * len(windows), [("low", [chr(0x4E00 + k) for k in range(1500)]), ("one", ["\u4e01"])])
    of, own = np.unique(classes, return_inverse=True)
    found, peaks = [], []
    for cells in (10**9, 200_000):
        monkeypatch.setattr(trees, "CELLS", cells)
        tracemalloc.start()
        found.append(tree._left(np.arange(len(windows)), own, n, len(of)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (found[0] == found[1]).all() and found[0].sum() > 0
    assert peaks[1] < 20_000_000 < 100_000_000 < peaks[0]


def test_counters(spark):
    start = dt.datetime(2020, 1, 1, 10)
    rows = [(start + dt.timedelta(seconds=s), "addWord") for s in range(0, 24, 2) for _ in range(2)] + [(start, "other")]
    events = spark.createDataFrame(rows, "ts timestamp, action string")
    last = counters.last_seconds(events).collect()
    assert len(last) == 10 and [r["total"] for r in last] == [2 * k for k in range(3, 13)]


def test_streams_match_batch(spark, tmp_path):
    start = dt.datetime(2020, 1, 1, 10)
    rows = spark.createDataFrame([(start + dt.timedelta(milliseconds=300 * k), "addWord" if k % 3 else "other") for k in range(50)], "ts timestamp, action string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_word_counts(stream).writeStream.format("memory").queryName("word_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("word_counts").collect())) == sorted(map(tuple, counters.per_second(rows).collect()))
    q = streams.stream_running_total(stream, start=100).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("running").first()["total"] == 100 + rows.where("action = 'addWord'").count()


def test_late_events_are_dropped(spark, tmp_path):
    start = dt.datetime(2020, 1, 1, 10)
    write = lambda name, seconds: spark.createDataFrame([(start + dt.timedelta(seconds=s), "addWord") for s in seconds], "ts timestamp, action string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = lambda: streams.stream_word_counts(spark.readStream.schema("ts timestamp, action string").parquet(str(tmp_path / "in/*")))
    run = lambda: stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    write("a", [0, 0, 1, 60])
    run()
    write("b", [0, 61, 200])  # second 0 comes too late
    run()
    got = {(r["sec"] - start).seconds: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 2 and got[1] == 1


def test_streamed_texts_and_feedback(spark, tmp_path):
    spark.createDataFrame([(1, "raam")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))
    q = streams.stream_transliterate(docs, "hindi").writeStream.format("memory").queryName("native_texts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("native_texts").collect()] == [(1, "राम")]
    schema = "wkey string, wvalue string, language string, mode string"
    spark.createDataFrame([("ram", "राम", "hindi", "word")], schema).write.parquet(str(tmp_path / "taught"))
    streams.append_feedback(spark.readStream.schema(schema).parquet(str(tmp_path / "taught")), str(tmp_path / "table"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def spellings(word, lang="hindi"):
    return ["".join(a) for a, _ in romanize.aligned(word, lang)]


def test_spellings():
    assert spellings("राम") == ["rAm", "ram"]
    assert spellings("और") == ["our"] and spellings("ऋण") == ["rin", "run"]
    assert spellings("abc") == [] and spellings("") == []
    assert spellings("आई") == ["AI", "aI", "Ai", "ai", "Ayi", "ayi", "AyI", "ayI"]
    assert spellings("ऊन") == ["Un"] and spellings("गाऊ")[-1] == "gavU"
    assert spellings("में") == ["men", "mein", "mem", "meim"] and spellings("बच्चा") == ["bachchA", "bachhA", "bachcha", "bachha"]
    assert spellings("रात") == ["rAt", "rat", "rAth", "rath"]
    assert "kkaN" not in spellings("ಕಣ", "kannada") and spellings("ಕಣ", "kannada") == ["kana"]
    assert spellings("ஃப", "tamil") == [] and "fan" not in spellings("அஃப", "tamil") and "afa" in spellings("அஃப", "tamil")
    assert romanize.aligned("राम", "hindi", cap=1) == romanize.aligned("राम", "hindi")[:1] and romanize.aligned("राम", "hindi", start=1) == romanize.aligned("राम", "hindi")[1:]
    typed, classes = romanize.aligned("खत", "hindi")[0]
    assert typed == list("khat") and classes == ["ख", romanize.EPSILON, romanize.EPSILON, "त"]
    for lang in ("hindi", "nepali", "gujarati", "tamil", "malayalam", "telugu"):
        for name, code in letters.alphabet(lang).items():
            assert letters.producers(lang)[code], name


def brute_examples(word, lang, scope, ahead):
    best = {}
    for rank, (typed, classes) in enumerate(romanize.aligned(word, lang)):
        latin = "".join(typed)
        for k, c in enumerate(classes):
            start = max(k - scope, 0)
            key = latin[k], latin[start : k + scope + 1], k - start
            if key not in best:
                marked = "#" + latin + "_"
                at = max(0, k + 1 - scope)
                best[key] = (latin[k], marked[at : k + 2 + ahead], k + 1 - at, c), rank
    return sorted(x for x, _ in best.values())


def test_examples_are_alike_listed_or_built(monkeypatch):
    words = ["कात" * 2, "कककक", "रात", "एएएए", "थ्थ", "लविएल्लेऐ", "तोथ्तिओनेदिन्ग", "आआआ", "क", "", "abc"]
    monkeypatch.setattr(romanize, "FEW", 10**6)
    listed = [sorted(romanize.examples_of(w, "hindi", 4, 6)) for w in words]
    monkeypatch.setattr(romanize, "FEW", 0)
    assert listed == [sorted(romanize.examples_of(w, "hindi", 4, 6)) for w in words]
    for word, found in zip(words, listed, strict=True):
        assert found == brute_examples(word, "hindi", 4, 6)


def test_examples_need_no_list_of_spellings():
    rng = random.Random(5)
    for lang in ("hindi", "tamil", "malayalam"):
        own = letters.properties(lang)
        for _ in range(60):
            word = "".join(rng.choice(own["cons"]) + rng.choice(["", own["mathra"][rng.randrange(5)], own["halanth"][0], own["anusvara"][0]]) for _ in range(rng.randint(1, 4)))
            if romanize.aligned(word, lang):
                assert sorted(romanize.examples_of(word, lang, 4, 6)) == brute_examples(word, lang, 4, 6), word
            for typed, classes in (romanize.aligned(word, lang) or [])[-2:]:
                literal = "".join(typed)
                first = next(x for x in romanize.aligned(word, lang) if "".join(x[0]) == literal)
                assert romanize.spelled_as(word, literal, lang) == first
    long = "".join(["कात"] * 12)  # 3 ** 12 * 2 ** 12 spellings
    assert len(romanize.aligned(long, "hindi")) == romanize.CAP and "".join(romanize.aligned(long, "hindi", 5, 3**11 * 2**12)[0][0]) != "" and len(romanize.examples_of(long, "hindi", 4, 6)) > 10
    assert romanize.spelled_as(long, "kAt" * 12, "hindi") is not None


def test_sounds(spark):
    own = lambda p, lang="hindi": phonemes.options(p.split(), lang)
    assert own("ae t") == [["A"], ["T"]] and own("k ae t") == [["k"], [".c", "ai"], ["T"]]
    assert own("ah n d") == [["a"], [".n"], ["D"]] and own("s ah m") == [["s"], ["a"], ["m", ".n"]]
    assert own("r ih ah") == [["r"], ["i"], ["yA"]] and own("hh aw er") == [[]] and own("t w ow1 aw ah") == [["T"], ["v"], ["O"], ["a"], ["vA"]]
    assert own("b - k") == [["b"], ["a", ""], ["k"]] and own("th ih th") == [["th"], ["i"], ["t"]] and own("n ey sh ah n") == [["n"], ["E"], ["sh"], ["a"], ["n"]]
    joined = lambda *p: one(spark, romanize.join_phones(F.array(*map(F.lit, p))))
    assert joined("k_s", "", "-ah", "t-", "-d", "#", "-#") == "k s - ah t - d -"
    sounds = romanize.sound_candidates(spark.createDataFrame([("knife", ["#", "n", "ay", "f", "#"])], "word string, phones array<string>"), "hindi")
    assert sounds.first()["options"] == ["नाइफ", "नैफ"]


def test_prediction_and_suggestions(spark):
    words = spark.createDataFrame([(w,) for w in ("राम", "रात", "कमल", "नाम", "मटर", "काम", "नमक", "अमर")], "word string")
    tree = jobs.train_language(words, "hindi").cache()
    typed = spark.createDataFrame([("ram",), ("kamal",), ("Ram",), ("zzz",), ("aur",), (None,), ("",)], "word string")
    got = {r["word"]: r for r in predict.predict_words(typed, tree, "hindi").collect()}
    assert set(got) == {"ram", "kamal", "Ram", "zzz", "aur"}
    assert "राम" in got["ram"]["options"] and got["kamal"]["options"][0] == "कमल" and got["zzz"]["options"] == [""] and got["zzz"]["valid"] == 0
    for r in got.values():
        assert ["".join(c) for c in r["chars"]] == r["options"]
    exact = spark.createDataFrame([("ram", "रॅम")], "typed string, native string")
    assert {r["word"]: r["options"] for r in predict.predict_words(typed, tree, "hindi", exact).collect()}["ram"] == ["रॅम"]
    single = spark.createDataFrame([("ram", 1)], "word string, single_at int")
    assert len(predict.predict_words(single, tree, "hindi").first()["options"]) <= len(got["ram"]["options"])
    lex = spark.createDataFrame([("राम",)], "word string")
    sounds = spark.createDataFrame([("ram", ["रैम"]), ("kamal", ["कमल"])], "word string, options array<string>")
    english, clash = spark.createDataFrame([("ram",)], "word string"), spark.createDataFrame([("ram",)], "word string")
    over = spark.createDataFrame([("kamal", ["कँवल"])], "latin string, options array<string>")
    shown = {r["word"]: r for r in predict.suggest(typed, "hindi", tree, lex, sounds, english, clash, over).collect()}
    assert shown["ram"]["options"][:2] == ["राम", "रैम"] and shown["kamal"]["options"][:2] == ["कँवल", "कमल"]
    assert shown["Ram"]["options"][:2] == ["राम", "रैम"] and (shown["Ram"]["itrans"], shown["ram"]["itrans"]) == ("ऱम", "रम")
    assert [r["option"] for r in predict.top_suggestion(predict.suggest(typed.limit(1), "hindi", tree, lex)).collect()] == ["राम"]
    other = predict.suggest(spark.createDataFrame([("Hello",)], "word string"), "klingon").first()
    assert other["options"] == ["hello"] and other["itrans"] == "Hello"
    body = json.loads(predict.suggest(typed.limit(1), "hindi", tree, lex).select(tables.to_response_json(F.col("word"), F.col("options"), F.col("optmap"), F.col("itrans")).alias("j")).first()["j"])
    assert body["inString"] == "ram" and body["twords"][0]["word"] is True and body["twords"][0]["options"][0] == "राम" and body["twords"][0]["optmap"]["राम"] == ["र", "ा", "म"]
    for r in predict.suggest(typed, "hindi", tree, lex, sounds, english, clash, over).collect():
        assert r["optmap"] and all("".join(own) == o for o, own in r["optmap"].items())
    asked = spark.createDataFrame([(["र", "ा", "म"], "ram", 1), (["x"], "ram", 1)], "chars array<string>, latin string, pos int")
    alternatives = {tuple(r["chars"]): r["options"] for r in predict.alternatives_at(asked, tree, "hindi").collect()}
    assert "राम" in alternatives["र", "ा", "म"] and alternatives[("x",)] == ["x"]
    marked = spark.createDataFrame([(1, r"ram \hindi ram, \itrans{rAm} \tamil ram"), (1, None)], "doc_id long, text string")
    assert sorted(r["text"] for r in jobs.render_markup(marked, models={"hindi": tree}).collect()) == ["", f"ram  {got['ram']['options'][0]}, राम  ram"]
    docs = spark.createDataFrame([(1, "Ram, kamal!"), (1, "kamal"), (None, "ram 2")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in jobs.transliterate_predicted(docs, "hindi", tree=tree, lexicon=lex).collect()) == [(0, "राम 2"), (1, "कमल"), (1, "राम, कमल!")]
    pairs = romanize.align_pair(spark.createDataFrame([("ram", "राम"), ("xy", "राम"), (None, "राम")], "literal string, word string"), "hindi").collect()
    assert {r["literal"]: (r["classes"], r["exact"]) for r in pairs} == {"ram": (["र", "ा", "म"], True), "xy": (["र", "ा", "म"], False)}
    back = {r["word"]: r["spellings"] for r in jobs.reverse_words_predictive(spark.createDataFrame([("राम",), ("abc",)], "word string"), "hindi").collect()}
    assert back == {"राम": ["rAm", "ram"], "abc": []}
    asked = spark.createDataFrame([("राम", "ram"), ("राम", "xy"), (None, "ram"), ("राम", "")], "word string, latin string")
    whole = {(r["latin"], r["pos"]): r["options"] for r in predict.alternatives_in_words(asked, tree, "hindi").collect()}
    assert set(whole) == {("ram", 0), ("ram", 1), ("ram", 2), ("xy", 0), ("xy", 1)} and whole["xy", 0] == ["राम"]
    one_by_one = spark.createDataFrame([(["र", "ा", "म"], "ram", k) for k in range(3)], "chars array<string>, latin string, pos int")
    assert all(whole["ram", r["pos"]] == r["options"] for r in predict.alternatives_at(one_by_one, tree, "hindi").collect())
    many = jobs.reverse_words_predictive(spark.createDataFrame([("राम",)], "word string"), "hindi", cap=1).first()
    assert many["spellings"] == ["rAm"] and many["truncated"]
    rest = jobs.reverse_words_predictive(spark.createDataFrame([("राम",)], "word string"), "hindi", cap=1, start=1).first()
    assert rest["spellings"] == ["ram"] and not rest["truncated"]
    pair = jobs.reverse_pairs(spark.createDataFrame([("राम", "कमल")], "first string, second string"), "hindi").first()
    assert pair["first_spellings"] == ["rAm", "raam"] and pair["second_spellings"] == ["kamal"]
    short = lookup.override_options(spark.createDataFrame([("Kamal", ["x", "y"]), ("ram", list("abcde"))], "latin string, options array<string>"), over)
    assert {r["latin"]: r["options"] for r in short.collect()} == {"Kamal": ["कँवल"], "ram": list("abcd")}


def test_model_and_examples_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("राम",), ("रात",)], "word string")
    tree = jobs.train_language(words, "hindi")
    tables.write_model(tree, str(tmp_path / "model"), "hindi")
    again = tables.read_model(spark, str(tmp_path / "model"), "hindi")
    assert sorted(map(str, again.select(*tree.columns).collect())) == sorted(map(str, tree.collect()))
    tables.write_examples(romanize.training_examples(words, "hindi"), str(tmp_path / "examples"))
    assert spark.read.parquet(str(tmp_path / "examples")).count() == romanize.training_examples(words, "hindi").count()
    rolled = jobs.rollup_transliterated(spark.createDataFrame([("raam rAm raam",)], "text string"), "hindi")
    tables.write_tsv_rollups(rolled, str(tmp_path / "rolled"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "rolled/freq")).collect()) == ["रम\t1", "राम\t2"]


def test_next_table_layout(spark):
    lex = spark.createDataFrame([("कका", 5), ("कक्त", 2), ("खका", 1)], "word string, n long")
    rows = {(r["prev"], r["key"]): [tuple(e) for e in r["entries"]] for r in lexicon.next_table(lex, "hindi").collect()}
    assert rows["क", "क"] == [("क्त", 4.0)] and ("^", "क") not in rows
    grid = dict(rows["#", "क"])
    assert list(grid)[:2] == ["क", "का"] and grid["क्"] == 0 and grid["का"] == 0.0 and len(grid) == len(lexicon.grid_cells("hindi")) - sum(c[0] != "क" for c in lexicon.grid_cells("hindi"))
    assert all(v == 0 for _, v in rows["#", "क़"])
    out = {r["id"]: r for r in lookup.next_options(spark.createDataFrame([(1, "कक", "क"), (2, "", "क"), (3, "क्", "ग")], "id long, typed string, key string"), lexicon.next_table(lex, "hindi"), "hindi").collect()}
    assert out[1]["compound"][0]["akshara"] == "क्त" and out[2]["prev"] == "^" and out[3]["joiner"] and out[3]["simple"] is None


def test_words_are_converted_after_they_are_counted(spark):
    docs = spark.createDataFrame([("raam kamal",)], "text string")
    for df in (jobs.rollup_transliterated(docs, "hindi"), lexicon.native_lexicon(lexicon.word_counts(docs), "hindi"), lexicon.akshara_bigrams(lexicon.native_lexicon(lexicon.word_counts(docs), "hindi"), "hindi")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.rindex("Aggregate ["):]  # the first aggregate, by word, and what feeds it
        assert "regexp_replace" not in below.split("\n", 1)[1] and "translate" not in below.split("\n", 1)[1]


def test_what_is_asked_of_converted_words_stays_above_the_count(spark):
    """Of joins, null tests and distinct words too, the planner moves none below the count, nor does it drop the count."""
    words = lexicon.word_counts(spark.createDataFrame([("raam kamal",)], "text string"))
    native = lexicon.native_lexicon(words, "hindi").select("word")
    form = scheme.scheme_to_script(F.col("word"), "hindi")
    phones = words.select(F.filter(F.split(text.strip_stress("word"), " "), lambda p: p != "").alias("phones"))
    shorter = native.select(F.col("word").alias("first"), F.expr("left(word, char_length(word) - 1)").alias("second")).join(native.withColumnRenamed("word", "second"), "second")
    for df in (
        romanize.align_pair(words.select(text.preprocess(F.col("word")).alias("literal"), form.alias("word")), "hindi"),
        romanize.romanizations(native, "hindi"),
        romanize.training_examples(native, "hindi"),
        romanize.phoneme_options(phones, "hindi"),
        shorter,
    ):
        parts = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[:-1]  # what stands right above each reading of the texts
        for part in parts:
            above = part[part.rindex("Aggregate ["):].split("\n")
            assert "count(1)" in above[0] and not any(x in "".join(above[1:]) for x in ("regexp_replace", "translate")), df
        assert parts


def test_each_row_has_its_own_sounds(spark):
    rows = spark.createDataFrame([("a", ["k", "ah"]), ("b", ["k", "ah"]), ("b", ["k", "ah"]), ("c", None), ("d", ["xx"]), ("e", [])], "word string, phones array<string>")
    done = romanize.sound_candidates(rows, "hindi")
    assert sorted((r["word"], tuple(r["options"])) for r in done.collect()) == [("a", ("का",)), ("b", ("का",)), ("b", ("का",)), ("d", ()), ("e", ("",))]
    assert not any(x in done._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Aggregate"))


def test_a_pronunciation_of_many_spellings_has_all_its_sounds(spark):
    """Beyond 100 spellings too, each sound once, in rows of every size; who wants the first makes no others."""
    said = {"z": ["z"] * 7, "bay": ["b", "-", "ay"] * 4, "mixed": ["b", "z-", "ae0", "m", "z-", "z", "aw", "z_-"], "few": ["n", "ay", "f"], "none": ["z"] * 8 + ["xx"], "": []}
    rows = spark.createDataFrame([*said.items(), ("null", None)], "word string, phones array<string>")
    for lang in ("hindi", "tamil"):
        want = {}
        for w, p in said.items():
            p = [x for x in " ".join(p).replace("_", " ").replace("-", " - ").replace("0", "").split(" ") if x]
            spelled = ["".join(reversed(o)) for o in itertools.product(*reversed(phonemes.options(p, lang)))]
            forms = spark.createDataFrame(list(enumerate(spelled)), "k long, s string").select("k", scheme.scheme_to_script(F.col("s"), lang)).collect()
            want[w] = list(dict.fromkeys(f for _, f in sorted(forms)))
        if lang == "hindi":
            assert len(want["z"]) == 128 and len(want["bay"]) == 3**4 and len(want["mixed"]) > 100 and want["none"] == []
        whole = romanize.sound_candidates(rows, lang).collect()
        assert {r["word"]: r["options"] for r in whole} == want and len(whole) == len(want) and all(r["rank"] == 0 for r in whole)
        for block in (10, 100, 1 << 20):
            got = {}
            for r in sorted(romanize.distinct_sounds(rows, lang, block).collect(), key=lambda r: (r["word"], r["rank"])):
                assert len(r["options"]) <= max(block // max(len(said[r["word"]]), 1), 1) and (r["options"] or r["word"] == "none")
                got.setdefault(r["word"], []).extend(r["options"])
            assert got == want
        assert {r["word"]: r["options"] for r in romanize.first_sounds(rows, lang).collect()} == {w: x[:1] for w, x in want.items()}
    longest = spark.createDataFrame([("zz", ["z"] * 200)], "word string, phones array<string>")
    assert [r["options"] for r in romanize.first_sounds(longest, "hindi").collect()] == [[one(spark, scheme.scheme_to_script(F.lit("J" * 200), "hindi"))]]
    assert [tuple(r)[1:] for r in jobs.rollup_sounded(spark.createDataFrame([("zz", 3)], "word string, n long"), "hindi", longest).collect()] == [(3, ["zz"])]


def test_texts_ask_for_their_words_by_blocks(spark):
    """Words are put back alike for blocks of every size; the driver holds few words, and no row is made for each text's each word."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["The", "raam", "x1", "Kumaar", "né", "zz"]) + rng.choice(["", "!", "q"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    some = lambda words: words.withColumn("out", F.when(F.col("word") != "zz", F.concat(F.upper("word"), F.lit("+"))))
    want = {(r["doc_id"], r["text"]) for r in lookup.apply_per_distinct_word(rows, some).collect()}
    assert len(want) == 300 and any("THE+" in t for _, t in want)
    for block in (1, 50, 10**6):
        assert {(r["doc_id"], r["text"]) for r in lookup.apply_per_distinct_word(rows, some, 0, block).collect()} == want
    assert lookup.SENT_CHARS <= 4_000_000
    assert "collect_list" not in lookup.apply_per_distinct_word(rows, some, 0)._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_node_is_counted_alike_with_and_without_sorting(monkeypatch):
    rng = random.Random(5)
    windows = ["#" + "".join(rng.choice("abct") for _ in range(8)) + "_" for _ in range(400)]
    offsets, classes = [rng.randrange(1, 9) for _ in windows], np.array([rng.randrange(3) for _ in windows])
    n = np.array([float(rng.randrange(1, 9)) for _ in windows])
    grown = []
    for cells in (trees.CELLS, 7):  # a cell for each beginning, and blocks of beginnings that occur
        monkeypatch.setattr(trees, "CELLS", cells)
        grown.append(list(trees._Subtree(windows, offsets, [("ab", ["a", "b"]), ("c", ["c"]), ("t", ["ta", "t"])]).grow(classes, n, ["x", "y", "z"], "")))
    assert grown[0] == grown[1] and len(grown[0]) > 50


def test_levels_shuffle_counts_and_no_examples(spark, monkeypatch):
    rng = random.Random(8)
    rows = collections.Counter()
    for _ in range(150):
        w = "#" + "".join(rng.choices(["kh", "a", "k", "h", "i", "é", "क"], k=6)) + "_"
        k = rng.randrange(1, len(w) - 1)
        start = max(0, k - 4)
        rows[w[start : k + 7], k - start, "XYZ"[hash(w[k] == "k") + (w[k - 1] == "a")]] += 1
    rows, groups = [(*r, n) for r, n in rows.items()], [("none", ["", "zz"]), ("kh", ["kh", "kha"]), ("k", ["k"])]
    want = plain_tree(rows, [*groups, *((c, [c]) for c in sorted({c for w, *_ in rows for c in w}))])
    # a row for each example, distance and beginning was shuffled at every level
    monkeypatch.setattr(trees, "split_counts", None)
    monkeypatch.setattr(trees, "NODE_BYTES", 30 * 950)
    assert grown(spark, rows, groups)[2] == want and len(want) > 5


def test_examples_are_counted_by_one_column(spark):
    words = spark.createDataFrame([("पत",), ("तप",)], "word string")
    found = romanize.training_examples(words, "hindi")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [told" in plan
    ahead = trees.reach(trees.SCOPE, letters.feature_groups("hindi"))
    want = collections.Counter(x for w in ("पत", "तप") for x in romanize.examples_of(w, "hindi", trees.SCOPE, ahead))
    assert {tuple(r)[:4]: r["n"] for r in found.collect()} == want


def test_rows_that_share_an_id_stay_apart(spark):
    rows = spark.createDataFrame([(1, "raam"), (1, "kumaar"), (None, "raam x"), (2, None)], "doc_id long, text string")
    upper = lambda words: words.withColumn("out", F.upper("word"))
    for sent in (lookup.SENT_CHARS, 0):  # words sent to all tasks, and words joined
        done = lookup.apply_per_distinct_word(rows, upper, sent)
        assert sorted((r["doc_id"] or 0, r["text"]) for r in done.collect()) == [(0, "RAAM X"), (1, "KUMAAR"), (1, "RAAM"), (2, "")]


def test_common_words_are_not_shuffled_to_one_task(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"{'ab' * (k % 3)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    zipf = [1 / (k + 1) for k in range(len(words))]
    rows = [(k, ", ".join(rng.choices(words, zipf, k=rng.randint(0, 40))) + "!") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    odd = lambda w: w.where("word <> 'aa'").withColumn("out", F.upper("word"))  # noqa: E731  # one word has no conversion
    monkeypatch.setattr(lookup, "COMMON", 0.02)
    want = {k: " ".join(x if x.strip(",!") == "aa" else x.upper() for x in t.split(" ")) for k, t in rows}
    for sent in (lookup.SENT_CHARS, 0):
        done = lookup.apply_per_distinct_word(docs, odd, sent)
        assert {r["doc_id"]: r["text"] for r in done.collect()} == want
    assert lookup.apply_per_distinct_word(docs.limit(0), odd, 0).count() == 0


def test_sources(spark, tmp_path):
    for name, body in (("lex", "राम\t5\n"), ("freq", "raat  10\n\nrAt 4\n"), ("set", "pan train\npan\n"), ("over", "header\nNamaste a b\nnamaste c d\n"), ("pron", "knife # n ay f #\n")):
        (tmp_path / name).write_text(body)
    at = lambda name: str(tmp_path / name)
    assert tables.read_lexicon(spark, at("lex"), "hindi").collect() == [("hindi", "राम", 5)]
    assert sorted(tables.read_word_freq(spark, at("freq")).collect()) == [("rAt", 4), ("raat", 10)]
    assert sorted(r["word"] for r in tables.read_wordset(spark, at("set"), "english", "dict").collect()) == ["pan", "train"]
    (tmp_path / "manifest").write_text("language file\nhindi over\n")
    assert [tuple(r) for r in tables.read_overrides(spark, at("manifest"), str(tmp_path)).collect()] == [("hindi", "namaste", ["c", "d"])]
    (tmp_path / "none").write_text("language file\n")
    assert tables.read_overrides(spark, at("none")).count() == 0
    assert [tuple(r) for r in tables.read_pron_dict(spark, at("pron")).collect()] == [("knife", ["", "n", "ay", "f", ""])]


def test_focus_follows_rewrites(spark):
    rows = spark.createDataFrame([("Boot", 3), ("boot", 1), ("cycle", 3), ("xx", 1)], "word string, focus long")
    got = {(r["word"], r["focus"]): (r["typed"], r["at"]) for r in romanize.preprocess_with_focus(rows).collect()}
    assert got == {("Boot", 3): ("bUt", 2), ("boot", 1): ("bUt", 1), ("cycle", 3): ("sykle", 3), ("xx", 1): ("kshksh", 3)}


def test_only_words_that_are_asked_for_are_sounded(spark):
    d = "/root/testdata/sf0.001"
    asked = {r["word"] for r in queries._typed(spark, d).collect()}
    sounded = queries._helpers(spark, d)["sounds"]
    found = {r["word"] for r in sounded.select("word").collect()}
    assert found and found == asked & {r["word"] for r in queries._words(spark, d).collect()}
