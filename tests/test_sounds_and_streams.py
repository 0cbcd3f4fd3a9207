"""Sound models against brute force, stored models, streams through restarts, and queries' parts that need files."""

import itertools
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from lipika.operators import lexicon, predict, romanize, sounds, trees
from lipika.plans import jobs
from lipika.sources import tables
from lipika.streaming import words as streams


def alignments(word, phones):
    """All ways to give each letter none, one or two phones in order."""
    for counts in itertools.product((0, 1, 2), repeat=len(word)):
        if sum(counts) == len(phones):
            at = list(itertools.accumulate(counts, initial=0))
            yield ["_".join(phones[at[k] : at[k + 1]]) for k in range(len(word))]


def test_expected_alignments_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        word, phones = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), [rng.choice("xyz") for _ in range(rng.randint(0, 7))]
        ways = list(alignments(word, phones))
        for chances in (None, {c: {n: rng.random() for n in ["", *"xyz", *("_".join(p) for p in itertools.product("xyz", repeat=2))]} for c in "abc"}):
            weight = [math.prod(1.0 if chances is None else chances[c][n] for c, n in zip(word, way, strict=True)) for way in ways]
            want = {}
            for way, w in zip(ways, weight, strict=True):
                for key in zip(word, way, strict=True):
                    want[key] = want.get(key, 0.0) + w / sum(weight)
            got = sounds.expected(word, phones, chances)
            assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
            if chances:
                found = sounds.likeliest(word, phones, chances)
                assert (found is None) == (not ways) and (not ways or weight[ways.index(found)] > max(weight) * (1 - 1e-9))


def test_words_are_aligned_together_as_alone(monkeypatch):
    """A batch's words at once, also block by block: words of any length, with more phones than they can have, and without any."""
    rng = random.Random(3)
    rows = [("".join(rng.choice("abé") for _ in range(rng.randint(1, 8))), [rng.choice(["x", "y", "x_y"]) for _ in range(rng.randint(0, 18))]) for _ in range(300)]
    columns = pa.array([w for w, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.list_(pa.string()))
    chances = {c: {n: rng.random() for n in ["", "x", "y", "x_y", "y_x", "x_x_y"]} for c in "abé"}
    for cells in (sounds.CELLS, 40):
        monkeypatch.setattr(sounds, "CELLS", cells)
        for own in (None, chances):
            together = sounds._Alignments(*columns, own)
            got, want = {}, {}
            for letter, name, n in zip(together.letters, together.names, together.expected(), strict=True):
                got[letter, name] = got.get((letter, name), 0.0) + n
            for word, phones in rows:
                for key, n in sounds.expected(word, phones, own).items():
                    want[key] = want.get(key, 0.0) + n
            assert {k for k, n in got.items() if n > 0} == set(want) and all(abs(got[k] - n) < 1e-9 * n for k, n in want.items())
        assert together.likeliest(len(rows)) == [sounds.likeliest(word, phones, chances) for word, phones in rows]


def test_spellings_from_parts_are_those_by_rank():
    rng = random.Random(4)
    for lang in ("hindi", "tamil"):
        known = sorted(romanize.letters.producers(lang))
        found = [(word, romanize.options_of(word, lang)) for word in ("".join(rng.choices(known, k=rng.randint(0, 8))) for _ in range(400))]
        mixed = [("कम", [("k", "q"), ("m", "")])]  # a letter that is blank in some spellings only
        for word, chain in [*((w, c) for w, c in found if c), *mixed]:
            many = romanize.number_of_spellings(chain)
            assert list(romanize._spellings(word, chain, many, 0)) == [("".join(a), b) for a, b in (romanize.spelling_at(word, chain, k) for k in range(many))]


# What each letter sounds like in the tests' language; a silent h after k.
PHONE = {"a": ["ah"], "i": ["ih"], "k": ["k"], "t": ["t"], "m": ["m"], "x": ["k", "s"], "n": ["n"], "h": []}


def test_sound_model_says_words_it_has_not_seen(spark):
    rng = random.Random(2)
    made = {"".join(rng.choice("kktmxnh") + rng.choice("ai") for _ in range(rng.randint(1, 4))) for _ in range(400)}
    say = lambda w: [p for c in w for p in PHONE[c]]
    known, unseen = sorted(made)[::2], sorted(made)[1::2]
    pron = spark.createDataFrame([(w, say(w)) for w in known] + [("a", ["ah"] * 5), ("", ["k"]), (None, ["k"]), ("zz", [None, "", "#"])], "word string, phones array<string>")
    aligned = {r["word"]: r["own"] for r in sounds.align_phones(pron).collect()}
    assert aligned["zz"] == ["", ""] and all(aligned[w] == ["_".join(PHONE[c]) for c in w] for w in known if w != "a")
    tree = sounds.train_sounds(pron).cache()
    said = {r["word"]: r["phones"] for r in sounds.predict_phones(spark.createDataFrame([(w,) for w in [*unseen, "Q", None, ""]], "word string"), tree).collect()}
    assert said.pop("q") == [""]
    assert said == {w: ["_".join(PHONE[c]) for c in w] for w in unseen}
    words = spark.createDataFrame([("kata",), ("xim",), ("XIM",)], "word string")
    own = spark.createDataFrame([("kata", ["g", "", "d", "aa"])], "word string, phones array<string>")
    got = {r["word"]: r for r in sounds.sound_words(words, "hindi", own, tree).collect()}
    assert got["kata"]["exact"] and got["kata"]["options"] == ["ग्डा"]
    assert not got["xim"]["exact"] and got["xim"]["options"] == ["क्सिम", "क्सिं"] and set(got) == {"kata", "xim"}
    rolled = jobs.rollup_sounded(spark.createDataFrame([("kata", 2), ("xim", 3), ("qq", 1)], "word string, n long"), "hindi", own, tree)
    assert sorted(map(tuple, rolled.collect())) == [("क्सिम", 3, ["xim"]), ("ग्डा", 2, ["kata"])]
    empty = spark.createDataFrame([], "word string, phones array<string>")
    assert sounds.align_phones(empty).count() == 0 and sounds.sound_words(words, "hindi").count() == 0


def test_models_of_other_languages_and_kinds_stay(spark, tmp_path):
    path = str(tmp_path / "models")
    own = {lang: jobs.train_language(spark.createDataFrame([(w,) for w in some], "word string"), lang).cache() for lang, some in (("hindi", ["राम", "रात"]), ("kannada", ["ರಾಮ", "ಕಮಲ"]))}
    sound = sounds.train_sounds(spark.createDataFrame([("ram", ["r", "aa", "m"])], "word string, phones array<string>"))
    for lang in own:
        tables.write_model(own[lang], path, lang)
    tables.write_model(sound, path, "hindi", tables.SOUND)
    plain = lambda df: sorted(str(r) for r in df.select("key", "node", "delta", "feature", "literals", "classes").collect())
    for lang in own:
        assert plain(tables.read_model(spark, path, lang)) == plain(own[lang])
    assert plain(tables.read_model(spark, path, "hindi", tables.SOUND)) == plain(sound)
    fewer = own["hindi"].where("key = 'r'").cache()
    tables.write_model(fewer, path, "hindi")  # trained anew: no key of before is left
    assert plain(tables.read_model(spark, path, "hindi")) == plain(fewer) and plain(tables.read_model(spark, path, "kannada")) == plain(own["kannada"])


def as_xml(rows):
    """Trees as elements, nodes numbered from left to right, each before those below it."""
    out = []
    for key in sorted({r["key"] for r in rows}):
        own = {r["node"]: r for r in rows if r["key"] == key}
        number = {}

        def visit(at, own=own, number=number):
            if own[at]["feature"] is not None:
                visit(at + "0")
            number[at] = len(number) + 1
            if own[at]["feature"] is not None:
                visit(at + "1")

        visit("")
        out.append(f'<tree key="{key}" type="predictive">')
        for at in sorted(own):
            r = own[at]
            leaf = r["feature"] is None
            feature = "None" if leaf else repr([*r["literals"], r["feature"]])
            classes = "[" + ", ".join(f'("{c["cls"]}", {c["n"]})' for c in r["classes"] or []) + "]"
            out.append(f"<node id=\"{number[at]}\"><split-rule><rel-index>{0 if leaf else r['delta']}</rel-index><context-id>-1</context-id><feature>{feature}</feature></split-rule><context-len>4</context-len><terminal>{leaf}</terminal><classes>{classes}</classes></node>")
        out.append("</tree>")
    return "<trees>\n" + "\n".join(out) + "\n</trees>\n"


def test_trees_from_xml_equal_those_from_parquet(spark, tmp_path):
    words = spark.createDataFrame([(w,) for w in ("राम", "रात", "कमल", "नाम", "मटर", "काम", "नमक", "अमर", "खत", "बच्चा")], "word string")
    tree = jobs.train_language(words, "hindi").cache()
    (tmp_path / "trees.xml").write_text(as_xml(tree.collect()), encoding="utf-8")
    again = tables.read_model_xml(spark, str(tmp_path / "trees.xml"))
    plain = lambda df: sorted(str(tuple(r)) for r in df.select("key", "node", "delta", "feature", "literals", "classes").collect())
    assert plain(again) == plain(tree) and tree.count() > 10
    typed = spark.createDataFrame([("ram",), ("kamal",)], "word string")
    pick = lambda t: sorted((r["word"], r["options"]) for r in predict.predict_words(typed, t, "hindi").collect())
    assert pick(again) == pick(tree)


def test_streams_go_on_after_a_restart(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).coalesce(1).write.parquet(at(name))
    second = lambda k: f"2020-01-01 10:00:{k:02d}"
    kind = "ts string, action string"
    events = lambda: spark.readStream.schema(kind).parquet(at("in*")).select(F.to_timestamp("ts").alias("ts"), "action")
    batches = [[(second(1), "addWord"), (second(1), "addWord"), (second(2), "other")], [(second(2), "addWord"), (second(1), "addWord"), (second(30), "addWord")]]
    want = [{1: 2}, {1: 3, 2: 1, 30: 1}]
    for k, rows in enumerate(batches):
        put(f"in{k}", rows, kind)
        for _ in range(2):  # the second run finds nothing new
            streams.count_words(events(), at("counts"), at("mark1")).awaitTermination()
            streams.add_to_total(events(), at("total"), at("mark2")).awaitTermination()
            assert {r["sec"].second: r["n"] for r in streams.read_counts(spark, at("counts")).collect()} == want[k]
            assert streams.read_total(spark, at("total"), 100).first()["total"] == 100 + sum(want[k].values())
    tree = jobs.train_language(spark.createDataFrame([("राम",), ("कमल",)], "word string"), "hindi").cache()
    over = spark.createDataFrame([("kamal", ["कँवल"])], "latin string, options array<string>")
    show = lambda rows: sorted({(r["word"], tuple(r["options"]), r["itrans"]) for r in rows})
    typed = []
    for k, own in enumerate((["ram", "kamal", "ram"], ["Ram", None])):
        typed += [(w,) for w in own]
        put(f"typed{k}", [(w,) for w in own], "word string")
        words = spark.readStream.schema("word string").parquet(at("typed*"))
        streams.suggest_words(words, "hindi", at("shown"), at("mark3"), tree=tree, overrides=over).awaitTermination()
        batch = predict.suggest(spark.createDataFrame(typed, "word string"), "hindi", tree=tree, overrides=over)
        assert show(spark.read.parquet(at("shown")).collect()) == show(batch.collect())


def test_focus_and_ranges_of_spellings(spark):
    rng = random.Random(6)
    for _ in range(40):
        word = "".join(rng.choice("abceihoupxw") for _ in range(rng.randint(1, 7)))
        plain, _ = romanize.follow_focus(word, 0, romanize.letters.REWRITES["hindi"])
        places = [romanize.follow_focus(word, k, romanize.letters.REWRITES["hindi"]) for k in range(len(word))]
        assert all(w == plain for w, _ in places)
        at = [k for _, k in places]
        assert at == sorted(at) and 0 <= at[0] and at[-1] < len(plain)
    whole = [r["latin"] for r in romanize.romanizations(spark.createDataFrame([("आईना",)], "word string"), "hindi").select("rank", F.array_join("letters", "").alias("latin")).orderBy("rank").collect()]
    parts = []
    for start in range(0, len(whole), 3):
        parts += [r["latin"] for r in romanize.romanizations(spark.createDataFrame([("आईना",)], "word string"), "hindi", cap=3, start=start).select("rank", F.array_join("letters", "").alias("latin")).orderBy("rank").collect()]
    assert parts == whole and len(whole) > 6
    assert lexicon.word_counts(spark.createDataFrame([(None,)], "text string")).count() == 0


def walked(tree, key, text, at):
    """The classes of one place of a marked text, node by node."""
    own = {r["node"]: r for r in tree if r["key"] == key}
    node = ""
    while own and own[node]["feature"] is not None:
        r = own[node]
        start = at + r["delta"]
        node += "0" if 0 <= start < len(text) and any(text.startswith(x, start) for x in r["literals"]) else "1"
    return [c["cls"] for c in own[node]["classes"]] if own else [""]


def test_symbols_of_several_letters_are_predicted_where_their_codes_begin(spark):
    rng = random.Random(9)
    codes = {"sh": "aB", "a": "aC", "t": "bB", "i:": "cBc", "m": "d"}
    say = {"sh": "श", "a": "ा", "t": "त", "i:": "ी", "m": "म"}
    some = [[rng.choice(["sh", "t", "m"]) if k % 2 == 0 else rng.choice(["a", "i:"]) for k in range(rng.randint(1, 6))] for _ in range(80)]
    examples = []
    for word in some[:60]:
        literal, at = "".join(codes[x] for x in word), 0
        for k, x in enumerate(word):
            text, start = "#" + literal + "_", max(0, at + 1 - 4)
            cls = "ट" if x == "t" and word[k + 1 : k + 2] == ["i:"] else say[x]
            examples.append((codes[x][0], text[start : at + 2 + 8], at + 1 - start, cls, 1))
            at += len(codes[x])
    tree = trees.grow(spark.createDataFrame(examples, "key string, window string, offset int, cls string, n long"), [("first", ["aB", "bB", "cBc"]), ("vowel", ["aC", "cBc"])]).cache()
    rows = spark.createDataFrame([(w,) for w in [*some, ["t", "zz"], [], None, ["t", None]]], "symbols array<string>")
    got = {tuple(r["symbols"]): r for r in predict.predict_symbols(rows, tree, codes).collect()}
    nodes = tree.collect()
    assert set(got) == {tuple(w) for w in some} | {("t", "zz")}
    for word in some:
        literal, at, chain = "".join(codes[x] for x in word), 0, []
        for x in word:
            chain.append(walked(nodes, codes[x][0], "#" + literal + "_", at + 1))
            at += len(codes[x])
        want = ["".join(reversed(x)) for x in itertools.product(*reversed(chain))]
        r = got[tuple(word)]
        assert r["typed"] == literal and r["options"] == want and r["valid"] == len(want) and ["".join(c) for c in r["chars"]] == want
    bad = got["t", "zz"]
    assert bad["options"] == ["tzz"] and bad["chars"] == [["t", "zz"]] and bad["valid"] == -1
    exact = spark.createDataFrame([("bBaC", ["थ", "ा"])], "typed string, chars array<string>")
    one = predict.predict_symbols(spark.createDataFrame([(["t", "a"],), (["m", "a"],)], "symbols array<string>"), tree, codes, "hindi", exact).collect()
    assert {tuple(r["symbols"]): (r["options"], r["valid"]) for r in one} == {("t", "a"): (["था"], 1), ("m", "a"): (["मा"], 1)}
