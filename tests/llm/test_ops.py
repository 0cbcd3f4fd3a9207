"""Each training-data operator against brute force, an exact round trip or held-out rows, with odd inputs."""

import collections
import glob
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lipika.llm import chat, decontaminate, fingerprints, lines, neardup, packing, quality, shards, toxicity, training_order
from lipika.llm.tokens import byte_bpe, tokenizer_path

from .kneser_ney import KneserNeyPair, summarise

DOCS = "doc_id long, text string, source string, extra string"
ODD = [(1, None, "a", "x"), (2, "", None, "x"), (3, "one", "a", None), (3, "one", "a", None), (None, "null id", "b", "x"), (5, "é ñ " * 3000, "b", "x"), (6, " \n\t ", "b", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def text_of(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words * 40)}" for _ in range(n))


# 1 ------------------------------------------------------------------------------------------------


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 17, 1000, 4097):
        for key in (0, 99):
            assert sorted(training_order.permute(np.arange(n), n, key)) == list(range(n))
    assert (training_order.permute(np.arange(1000), 1000, 1) != training_order.permute(np.arange(1000), 1000, 2)).any()


def test_shards_hold_what_the_index_says(spark, odd, tmp_path):
    length, slots = 32, 8
    index = training_order.training_order(odd, str(tmp_path / "s"), key=5, length=length, slots_a_shard=slots).toPandas().sort_values("slot")
    assert list(index["slot"]) == list(range(len(index))) == sorted(index["number"])
    stride, stream = training_order.stride(length), {}
    for r in index.itertuples():
        (file,) = glob.glob(str(tmp_path / f"s/shard={r.shard}/*.txt"))
        with open(file, "rb") as f:
            f.seek(r.offset)
            record = np.frombuffer(f.read(stride), "<u2")
        ids = record[1 : 1 + record[0]]
        assert record[-1] == training_order.MARK and record[0] == r.n_tokens and zlib.crc32(ids.tobytes()) == r.ids_crc32
        stream[r.number] = ids
    encode = byte_bpe(tokenizer_path())
    want = collections.Counter(encode(t) + (50256).to_bytes(2, "little") for _, t, *_ in ODD)
    whole = np.concatenate([stream[k] for k in sorted(stream)])
    cuts = np.flatnonzero(whole == 50256) + 1
    assert collections.Counter(p.tobytes() for p in np.split(whole, cuts)[:-1]) == want
    assert training_order.training_order(odd.limit(0), str(tmp_path / "none")).count() == 0


def test_ids_are_those_of_the_json_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    encode = byte_bpe(tokenizer_path())
    for t in ("", " ", "a  b", "it's n't <|endoftext|> z", "a\tb c", "é́ ñ 12 34.5 \x85", "x" * 5000):
        assert np.frombuffer(encode(t), "<u2").tolist() == exact.encode(t, add_special_tokens=False).ids
    assert encode(None) == b""


# 2 ------------------------------------------------------------------------------------------------


def plain_words(text):
    """As the contracts have it, without the library's own function."""
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute_contaminated(text, items):
    own, found = plain_words(text or ""), {}
    for item, passage in items:
        wanted = plain_words(passage or "")
        n, k = len(wanted), min(5, len(wanted))
        if not n or len(own) < n:
            continue
        runs = lambda w: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))  # noqa: E731, B023
        best, b = 0.0, runs(wanted)
        for s in range(len(own) - n + 1):
            a = runs(own[s : s + n])
            both = sum((a & b).values())
            best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
        if best >= 0.75:
            found[item] = round(best, 9)
    return found


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(3)
    items = [(k, text_of(rng, rng.randint(12, 40))) for k in range(15)] + [(90, "two words"), (91, ""), (92, None), (93, "a b a b a b a b a b a b")]
    docs = []
    for k in range(120):
        body = text_of(rng, rng.randint(0, 80)).split()
        if k % 2:
            passage = rng.choice(items[:15])[1].split()
            for _ in range(rng.randint(0, 3)):
                passage[rng.randrange(len(passage))] = "changed"
            body[len(body) // 2 : len(body) // 2] = passage
        docs.append((k, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "Two  WORDS"), (203, "a b a b a b a b a b a b")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = collections.defaultdict(dict)
    for r in found.collect():
        got[r["doc_id"]][r["item_id"]] = round(r["similarity"], 9)
    assert dict(got) == {d: f for d, t in docs if (f := brute_contaminated(t, items))}
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_contaminated_takes_odd_columns(spark):
    rng = random.Random(31)
    items = spark.createDataFrame([("x1", "one two three four five six seven eight", "clash"), ("x1", text_of(rng, 12), None), (None, "nine ten eleven twelve", "y"), ("x3", None, "y")], "item_id string, text string, doc_id string")
    long = text_of(rng, 400_000) + " one two three four five six seven eight"
    docs = spark.createDataFrame([("a", "ONE two three four five six seven eight", 1), ("a", "ONE two three four five six seven eight", 1), (None, "nine ten eleven twelve", 2), ("b", long, 3), ("c", None, 4)], "doc_id string, text string, item_id int")
    got = collections.Counter((r["doc_id"], r["item_id"], r["similarity"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == {("a", "x1", 1.0): 2, (None, None, 1.0): 1, ("b", "x1", 1.0): 1}
    for kind in ("date", "double"):
        other = spark.sql(f"SELECT CAST(NULL AS {kind}) AS item_id, 'nine ten eleven twelve' AS text")
        assert decontaminate.contaminated(docs, other).count() == 1


def test_batches_of_items_are_all_searched(spark, monkeypatch):
    rng = random.Random(32)
    passages = [(k, text_of(rng, 15)) for k in range(30)]
    docs, items = spark.createDataFrame(passages, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BATCH_CHARS", 1000)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()) == [(k, k) for k in range(30)]


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(1)
    index = decontaminate.ItemIndex([(k, text_of(random.Random(k), 20)) for k in range(500)])
    bits = np.unpackbits(index.prints.view(np.uint8), axis=1)
    touched = []
    for _ in range(200):
        near = bits[rng.integers(500)].copy()
        near[rng.choice(256, rng.integers(0, 90), replace=False)] ^= 1
        print_ = np.packbits(near).view("<u2")
        want = np.flatnonzero((bits != near).sum(1) <= decontaminate.RADIUS)
        assert index.within(print_, 20).tolist() == want.tolist()
        touched.append(len(index.touched(print_, 20)))
    assert np.mean(touched) < 0.25 * 500  # the lists of near values, not all items


# 3 ------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\l<b[\\e"), (2, 0, "assistant", None), (3, 0, "tool<", "x"), (3, 1, None, "y"), (None, 0, "user", "z"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a" * 50_000), (5, 0, "user", "t"), (5, 0, "user", "t")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_conversations(turns).withColumn("read", chat.read_back(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("segments")))
    got = {r["conv_id"]: r for r in done.collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, said in rows:
        by[conv].append((turn, role or "", said or ""))
    for conv, own in by.items():
        assert [tuple(x) for x in got[conv]["read"]] == [(r, t) for _, r, t in sorted(own)]
        assert got[conv]["learned"] == "".join(t for _, r, t in sorted(own) if r == "assistant")
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: True, 5: False}
    assert chat.format_conversations(turns.limit(0)).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def plain_digest(text):
    """The digest by its docstring: hashed byte triplets of each shape, quartiles, two bits a bucket."""
    counts = [0] * 1024
    for k, (a, b, c) in enumerate(((0, 3, 7), (0, 1, 2), (0, 1, 3), (0, 2, 4))):
        for i in range(len(text) - c):
            x = (text[i + a] * 0x9E3779B1 & 0xFFFFFFFF) ^ (text[i + b] * 0x85EBCA77 & 0xFFFFFFFF) ^ (text[i + c] * 0xC2B2AE3D & 0xFFFFFFFF) ^ (0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            counts[x >> 22] += 1
    order = sorted(counts)
    codes = [sum(n > order[q] for q in (256, 512, 768)) for n in counts]
    size = min(255, int(math.log1p(len(text)) / math.log(1.1)))
    return bytes([size, *(sum(codes[4 * j + m] << 2 * m for m in range(4)) for j in range(256))])


def plain_likeness(a, b):
    steps = sum((0, 1, 2, 6)[abs((x >> m & 3) - (y >> m & 3))] for x, y in zip(a[1:], b[1:], strict=True) for m in (0, 2, 4, 6))
    mean = sum((0, 1, 2, 6)[abs(i - j)] for i in range(4) for j in range(4)) / 16
    return 1 - min(1, (steps + 4 * abs(a[0] - b[0])) / (1024 * mean))


def test_fingerprints_match_a_plain_loop(spark, odd, monkeypatch):
    rng = random.Random(4)
    rows = [(k * 7 % 101, text_of(rng, rng.randint(0, 300))) for k in range(101)]
    for size in (5000, 10):
        monkeypatch.setattr(fingerprints, "DOCUMENTS_A_PART", size)
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        own = sorted(rows)
        for k, (doc, text) in enumerate(own):
            following = own[(k + 1) % len(own)][1]
            edited = fingerprints.edit(text, following)
            r = got[doc]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
            own_print, after = plain_digest(text.encode()), plain_digest(edited.encode())
            assert (r["fingerprint"], r["edited_fingerprint"]) == (own_print.hex(), after.hex())
            assert abs(r["near_edited"] - plain_likeness(own_print, after)) < 1e-9
            assert abs(r["near_next"] - plain_likeness(own_print, plain_digest(following.encode()))) < 1e-9
    assert fingerprints.fingerprint_pairs(odd).count() == len(ODD)
    assert fingerprints.fingerprint_pairs(odd.limit(0)).count() == 0


def test_short_texts_have_fingerprints_of_their_own():
    texts = {n: [bytes(random.Random(n * 10 + k).choices(range(97, 123), k=n)) for k in range(5)] for n in range(3, 9)}
    texts[3] += [b"cat", b"dog"]
    for own in texts.values():
        prints = [fingerprints.digest(t) for t in own]
        assert len(set(prints)) == len(own) and all(any(p[1:]) for p in prints)


# 5 ------------------------------------------------------------------------------------------------


def test_packing_covers_every_id_once(spark, odd):
    rng = random.Random(5)
    rows = [(100 + k, text_of(rng, rng.randint(0, 400)), rng.choice("aaaab"), "x") for k in range(300)]
    docs = spark.createDataFrame(ODD + rows, DOCS).repartition(5)
    got = packing.pack(docs, sequence=128, window=1024, unit=1, with_ids=True).toPandas().sort_values(["sequence_id", "offset"])
    totals = got.groupby("sequence_id")["length"].sum()
    assert (totals.iloc[:-1] == 128).all() and totals.iloc[-1] <= 128 and list(totals.index) == list(range(len(totals)))
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    encode = byte_bpe(tokenizer_path())
    want = {d: np.frombuffer(encode(t) + b"\0\0", "<u2").tolist() for d, t, *_ in rows}
    for doc, own in got[got["doc_id"] >= 100].sort_values("start").groupby("doc_id"):
        assert np.frombuffer(b"".join(own["ids"]), "<u4").tolist() == want[doc]
        assert (own["doc_tokens"] == len(want[doc])).all() and all(zlib.crc32(i) == c for i, c in zip(own["ids"], own["ids_crc32"], strict=True))
    shares = got[got["source"] == "b"].groupby("window")["length"].sum().iloc[:-1]
    assert shares.max() - shares.min() <= 12  # the mixture holds in every window
    assert got["length"].sum() == sum(map(len, want.values())) + sum(len(encode(t)) // 2 + 1 for _, t, *_ in ODD)
    assert packing.pack(docs.limit(0)).count() == 0
    many = packing.pack(docs.withColumn("source", F.col("doc_id").cast("string"))).toPandas()
    assert many.groupby("doc_id")["length"].sum()[110] == len(want[110])


def test_mixture_holds_for_any_number_of_sources(spark):
    rng = random.Random(51)
    rows = [(k, text_of(rng, rng.randint(50, 200)), f"s{k % 600}" if k % 3 else "large") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(docs, window=16_384, unit=16).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].sum().iloc[:-1] == 1024).all()
    at = got["sequence_id"] * 1024 + got["offset"]
    assert (at.diff().iloc[1:] == got["length"].shift().iloc[1:]).all() and at.iloc[0] == 0
    lengths, windows = got.groupby("source")["length"].sum(), got["window"].max() + 1
    assert windows == -(-got["length"].sum() // 16_384) and got["window"].is_monotonic_increasing
    for n in range(1, windows):
        sent = got[got["window"] < n].groupby("source")["length"].sum().reindex(lengths.index, fill_value=0)
        assert (sent - lengths * n / windows).abs().max() <= 32  # a deficit is at most a unit, and the last unit may be a short one


def test_targets_hold_until_a_source_runs_dry(spark):
    rng = random.Random(52)
    rows = [(k, text_of(rng, 100), "abcd"[k % 4]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, window=2048, unit=1, targets={"a": 0.5, "b": 0.2, "zero": 0.0}).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == got.groupby("doc_id")["doc_tokens"].first().to_dict()
    shares = got.groupby(["window", "source"])["length"].sum().unstack(fill_value=0)
    assert (abs(shares.iloc[:10].div(shares.iloc[:10].sum(axis=1), axis=0) - [0.5, 0.2, 0.15, 0.15]).max() < 0.002).all()
    after = shares[(shares["a"] == 0) & (shares["b"] > 0)].iloc[:-1]  # a has run dry; the others keep their proportions
    assert len(after) and (abs(after["b"] / after["c"] - 0.2 / 0.15) < 0.05).all()
    last = packing.pack(docs, window=2048, unit=1, targets={"a": 0.0, "b": 1.0}).toPandas()
    span = lambda x: x["sequence_id"] * 1024 + x["offset"]
    assert span(last[last["source"] == "b"]).max() < span(last[last["source"] != "b"]).min()
    assert packing.pack(docs.limit(0), targets={"a": 1.0}).count() == 0


def test_packed_ids_are_those_of_the_json_file_as_it_is(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", " <|endoftext |>", "plain text"]
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in packing.pack(docs, with_ids=True).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*exact.encode(texts[r["doc_id"]], add_special_tokens=False).ids, packing.END]


# 6 ------------------------------------------------------------------------------------------------


def test_best_fit_decreasing_matches_a_plain_search():
    rng = random.Random(6)
    for _ in range(60):
        items = [rng.randint(0, rng.choice([12, 50, 70])) for _ in range(rng.randint(0, 80))]
        where, bins = shards.best_fit_decreasing(collections.Counter(items).items(), 60)
        left, plain = [], collections.Counter()
        for size in sorted(items, reverse=True):
            fits = [(room, k) for k, room in enumerate(left) if room >= size]
            k = min(fits)[1] if fits else len(left)
            if not fits:
                left.append(max(60, size))
            left[k] -= size
            plain[size, k] += 1
        packed = collections.Counter()
        for size, homes in where.items():
            for k, n in homes:
                packed[size, k] += n
        assert (packed, bins) == (plain, len(left))


def test_sharding(spark, odd):
    rng = random.Random(7)
    rows = [(100 + k, text_of(rng, rng.randint(1, 100)), "a", "x") for k in range(500)] + [(1000 + k, "copy " * 200, "a", "x") for k in range(300)]
    docs = spark.createDataFrame(ODD + rows, DOCS)
    got = shards.shard_documents(docs).toPandas()
    assert len(got) == len(ODD) + len(rows) and set(got["shard"]) <= set(range(8))
    assert (got.groupby("shard")["slot"].max() + 1 == got.groupby("shard")["slot"].count()).all() and not got.duplicated(["shard", "slot"]).any()
    assert got.groupby(["text_crc32", "size"])["shard"].nunique().max() == 1
    rest = got[got["shard"] != got[got["doc_id"] >= 1000]["shard"].iloc[0]].groupby("shard")["size"].sum()
    assert rest.max() < 1.1 * rest.min()  # the others share evenly beside the indivisible copies
    assert shards.shard_documents(docs.limit(0)).count() == 0


def test_groups_are_packed_by_size_at_any_number(spark):
    rng = random.Random(14)
    sizes = [int(rng.paretovariate(1.1) * 20) for _ in range(30_000)] + [70_001, 131_075]
    rows = spark.createDataFrame([(f"k{k}", s) for k, s in enumerate(sizes)], "key string, size long").repartition(3)
    got = shards.assign_shards(rows, 5).toPandas()
    assert sorted(got["key"]) == sorted(f"k{k}" for k in range(len(sizes)))
    want = collections.Counter((s, home) for s, homes in shards.pack_into(collections.Counter(sizes).items(), 5).items() for home, n in homes for _ in range(n))
    if max(sizes) < 65_536:
        assert collections.Counter(zip(got["size"], got["shard"], strict=True)) == want
    loads = got.groupby("shard")["size"].sum()
    even = loads[loads.index >= sum(s > sum(sizes) / 5 for s in sizes)]
    assert even.max() < 1.001 * even.min()


def test_fixed_capacity(spark):
    rng = random.Random(15)
    rows = spark.createDataFrame([(f"g{k // 2}", rng.randint(1, 40)) for k in range(400)] + [("huge", 500)], "key string, size long")
    got = shards.fixed_capacity_shards(rows, 100).toPandas()
    assert len(got) == 401 and got.groupby("key")["shard"].nunique().max() == 1
    loads = got.groupby("shard")["size"].sum().sort_values()
    assert loads.iloc[-1] == 500 and loads.iloc[-2] <= 100
    sizes = collections.Counter(got.groupby("key")["size"].sum())
    assert len(loads) == shards.best_fit_decreasing(sizes.items(), 100)[1] <= 1.25 * -(-sum(got["size"]) // 100)


def test_shards_pass_other_columns_through(spark):
    rows = [("a", 5, 1, "x", 7), ("a", 3, 2, None, 8), (None, 4, 3, "y", 9), (None, None, 4, "z", 9), ("b", None, 5, "", 1)]
    named = spark.createDataFrame(rows, "key string, size long, shard int, __strip string, of int").withColumnsRenamed({"of": "k"})
    for placed in (shards.assign_shards(named, 3), shards.fixed_capacity_shards(named, 6)):
        assert placed.columns == ["key", "size", "__strip", "k", "shard"]
        got = placed.collect()
        key = lambda r: tuple((x is not None, x if x is not None else "") for x in r)
        assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=key) == sorted(((a, b, d, e) for a, b, _, d, e in rows), key=key)
        homes = {}
        for r in got:
            assert homes.setdefault(r["key"], r["shard"]) == r["shard"]  # rows of a null key are one group
    numbered = shards.number_slots(named.withColumn("__k", F.lit(1)).withColumn("slot", F.lit(-1)), ["size"], 5, "key")
    assert numbered.columns == ["key", "size", "shard", "__strip", "k", "__k", "slot"]
    assert sorted(((r["key"] or "", r["slot"]) for r in numbered.collect())) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("b", 0)]


@pytest.mark.parametrize("share", [0.33, 0.2])
def test_shards_beside_a_large_group_are_even(spark, share):
    rng = random.Random(12)
    small = [(f"k{k}", rng.randint(50, 150)) for k in range(20_000)]
    large = int(sum(s for _, s in small) * share / (1 - share))
    sizes = collections.Counter()
    for r in shards.assign_shards(spark.createDataFrame([*small, ("large", large)], "key string, size long"), 8).collect():
        sizes[r["shard"]] += r["size"]
    assert sorted(sizes) == list(range(8))
    *others, most = sorted(sizes.values())
    assert most == large and others[-1] < 1.02 * others[0]


def test_every_shard_is_used_for_few_items():
    for sizes, n in (([4] * 5, 4), ([9, 5, 5, 5, 1], 4), ([7], 3), ([0, 0], 2), ([], 2), ([50, 30, 5, 5, 5, 5], 6)):
        where = shards.pack_into(collections.Counter(sizes).items(), n)
        assert sum(k for homes in where.values() for _, k in homes) == len(sizes)
        assert len({home for s, homes in where.items() if s for home, _ in homes}) == min(n, sum(map(bool, sizes)))


# 7, 8 ---------------------------------------------------------------------------------------------


def test_network_gradient():
    net = quality.ByteConvNet()
    text, label = b"some bytes, more bytes %%% and so on " * 20, 0
    tables = net._tables()
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    net._gradient(text, label, tables, g)
    loss = lambda: float(np.log1p(np.exp(net.logit(text, net._tables()))))
    for name in ("filters", "embed", "hidden", "out"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step, kept = 1e-3, net.p[name][at]
        net.p[name][at] = kept + step
        up = loss()
        net.p[name][at] = kept - step
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / (2 * step) - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-3


def test_network_matches_plain_loops():
    net, rng = quality.ByteConvNet().fit([b"good words here " * 9, b"%%% bad %%% " * 30] * 4, [1, 0] * 4, epochs=2), random.Random(71)
    p = net.p
    for n in (0, 1, 127, 128, 129, 256, 300, 1000):
        text = bytes(rng.randrange(256) for _ in range(n))
        halves = max(2, -(-n // 128))
        padded = list(text) + [256] * (halves * 128 + 4 - n)
        value = [[sum(float(p["embed"][padded[i + k]] @ p["filters"][k, :, f]) for k in range(5)) for f in range(16)] for i in range(halves * 128)]
        units = [0.0] * 16
        for c in range(halves - 1):
            pooled = [max(0.0, max(v[f] for v in value[c * 128 : c * 128 + 256]) + float(p["bias"][f])) for f in range(16)] + [min(1.0, max(0.0, (n - 128 * c) / 256))]
            for u in range(16):
                units[u] = max(units[u], sum(x * float(w) for x, w in zip(pooled, p["hidden"][:, u], strict=True)) + float(p["hidden_bias"][u]))
        logit = sum(a * float(b) for a, b in zip(units, p["out"], strict=True)) + float(p["out_bias"][0])
        assert abs(net.scores([text])[0] - 1 / (1 + math.exp(-logit))) < 1e-4


@pytest.mark.parametrize("marks", [[], [(k, None) for k in range(40)], [(k, 1) for k in range(40)]])
def test_few_or_one_sided_labels(spark, marks):
    docs = spark.createDataFrame([(k, text_of(random.Random(k), 30)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, m, m) for d, m in marks], "doc_id long, quality int, toxic int")
    scores = quality.score_quality(docs, quality.fit_quality(docs, labels)).toPandas()["score"]
    assert (scores >= 0.5).all() and (any(m for _, m in marks) or (scores == 0.5).all())
    toxic = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).toPandas()["score"]
    assert len(toxic) == 40 and (toxic < 0.01).all()


def auc(score, label):
    rank = score.argsort().argsort() + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out(spark, odd, kind):
    rng = random.Random(8)
    rows, marks = [], []
    for k in range(700):
        text, bad = text_of(rng, rng.randint(20, 120), 20), rng.random() < 0.3
        if bad and kind == "quality":
            text = text.replace(" ", "%%% ")
        if bad and kind == "toxic":
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zzidiot", "qqmoron"]))
            text = " ".join(words)
        rows.append((k, text))
        marks.append((k, int(bad) ^ (kind == "quality")))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, f"doc_id long, {kind} int")
    if kind == "quality":
        net = quality.fit_quality(docs, labels, rows=300)
        score = lambda d: quality.score_quality(d, net)
    else:
        model = toxicity.fit_toxicity(docs, labels)
        score = lambda d: toxicity.score_toxicity(d, model)
    got = score(docs).where(~quality.learning_fold(F.col("doc_id"))).toPandas().merge(labels.toPandas(), on="doc_id")
    assert auc(got["score"].to_numpy(), got[kind].to_numpy()) > 0.95
    extra = score(odd.withColumn("score", F.lit("clash"))).toPandas()
    assert len(extra) == len(ODD) and extra["score"].between(0, 1).all()
    assert score(odd.limit(0)).count() == 0


def test_kneser_ney_sums_to_one(spark):
    rows = spark.createDataFrame([("abracadabra " * 5, 1), ("abra cadence " * 7, 0), ("brand new " * 3, 0)], "text string, label int")
    counts = {r["key"]: (r["toxic"], r["ordinary"]) for r in toxicity.count_ngrams(rows).collect()}
    plain = collections.defaultdict(lambda: [0, 0])
    for t, m in rows.collect():
        for key in toxicity.ngrams(t.encode()).tolist():
            plain[key][1 - m] += 1
    assert counts == {k: tuple(v) for k, v in plain.items()}
    summary = summarise(toxicity.count_ngrams(rows)).toPandas()
    pair = KneserNeyPair(summary)
    assert pair.differences(b"abracadabra").mean() > 0 > pair.differences(b"brand new").mean()
    for of in (0, 1):
        chance = plain_kneser_ney(summary, ("toxic", "ordinary")[of])
        for context in (b"abra", b"rand", b"zzzz", b"\n\n\n\n", b"xbra"):
            every = [chance(int.from_bytes(context, "big") << 8 | byte) for byte in range(256)]
            assert abs(sum(every) - 1) < 1e-9 and min(every) > 0
    for text in (b"abracadabra brand", b"never seen"):
        both = [np.array([math.log(chance(int(k)) + 0) for k in toxicity.ngrams(text)]) for chance in (plain_kneser_ney(summary, "toxic"), plain_kneser_ney(summary, "ordinary"))]
        # equal up to the small constants that keep the logarithms finite
        assert np.abs(pair.differences(text) - (both[0] - both[1])).max() < 0.01


def plain_kneser_ney(summary, of):
    """The interpolated probability of an n-gram's last byte, straight from counts: the class's own above order 2, both classes' below."""
    grams = {o: {int(r.key): int(getattr(r, of)) if o > 2 else int(r.toxic + r.ordinary) for r in summary[summary["order"] == o].itertuples()} for o in range(1, 6)}
    def discount(o):
        once, twice = (sum(n == k for n in grams[o].values()) for k in (1, 2))
        return min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    cut = {o: discount(o) for o in grams}

    def chance(key, order=5):
        if order == 0:
            return 1 / 256
        own = {k: n for k, n in grams[order].items() if k >> 8 == key >> 8}
        total, below = sum(own.values()), chance(key & ((1 << 8 * (order - 1)) - 1), order - 1)
        if not total:
            return below
        return max(own.get(key, 0) - cut[order], 0) / total + cut[order] * sum(n > 0 for n in own.values()) / total * below

    return chance


def test_ngrams_are_exact_at_any_number(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    texts = [(k, " ".join(word() for _ in range(200)), k % 2) for k in range(40)]
    counts = toxicity.count_ngrams(spark.createDataFrame(texts, "doc_id long, text string, label int"))
    summary = summarise(counts).toPandas()
    for order in range(1, toxicity.ORDER + 1):
        different = {int(k) & ((1 << (8 * order)) - 1) for _, t, _ in texts for k in toxicity.ngrams(t.encode())}
        assert (summary["order"] == order).sum() == len(different)  # no two share a place
    pair = KneserNeyPair(summary)
    more = [*texts[:3], *[(100 + k, " ".join(word() for _ in range(50)), 0) for k in range(5)], (200, "", 0), (201, None, 0), (202, "Žluťoučký", 1)]
    docs = spark.createDataFrame(more, "doc_id long, text string, label int").repartition(2)
    for block in (toxicity.BLOCK, 500):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got = toxicity._with_evidence(docs, toxicity.DifferenceTables(counts), "x", T.ArrayType(T.DoubleType()), lambda x: x.tolist()).collect()
        assert len(got) == len(more)
        for r in got:
            assert np.allclose(r["x"], toxicity.evidence(pair.differences((r["text"] or "").encode())))


def test_scores_do_not_hang_on_partitions(spark):
    rows = [(k, f"row {k % 97} says {'zzbad stuff' if k % 3 == 0 else 'fine things'} {k % 11}", int(k % 3 == 0)) for k in range(400)]
    rows += [(k, f"another text of {k}", int(k % 3 == 0)) for k in range(0, 400, 5)]  # ids that stand twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = []
    for given in (docs.coalesce(1), docs.repartition(7), docs.repartition(40, "text"), docs.orderBy(F.desc("text"))):
        given = given.select("doc_id", "text")
        scored = toxicity.score_toxicity(given, toxicity.fit_toxicity(given, labels)).collect()
        found.append(sorted((r["doc_id"], r["text"], round(r["score"], 6)) for r in scored))
    assert len(found[0]) == len(rows) and all(f == found[0] for f in found)
    plan = toxicity.score_toxicity(docs.select("doc_id", "text"), toxicity.fit_toxicity(docs, labels))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan  # tasks do not grow with the number of blocks


@pytest.mark.parametrize("most", [10, toxicity.CALIBRATION_ROWS])
def test_all_learning_rows_are_counted(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", most)
    rows = [(k, f"row {k:04d} says {'zzbad' if k % 3 == 0 else 'fine'}", int(k % 3 == 0)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    seen = {r["key"] for r in model.tables.seen[toxicity.ORDER].collect()}
    learning = docs.where(quality.learning_fold(F.col("doc_id"))).collect()
    assert seen == {k for r in learning for k in toxicity.ngrams(r["text"].encode()).tolist()}


# 9 ------------------------------------------------------------------------------------------------


def test_lines_match_brute_force(spark, odd):
    rng = random.Random(9)
    rows = [(k, "\n".join(rng.choice(["menu", "footer", "", " ", f"line {rng.randrange(400)}"]) for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", None])) for k in range(300)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, host string, clean string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(pages).collect()}
    totals, seen = collections.Counter(h for *_, h in rows), collections.Counter((h, x) for _, t, h in rows for x in set(t.split("\n")) if x.strip(" "))
    bad = {k for k, n in seen.items() if n > 1 and n > lines.RATIO * totals[k[0]]}
    assert bad
    for doc, t, h in rows:
        kept = [x for x in t.split("\n") if (h, x) not in bad]
        assert (got[doc]["clean"], got[doc]["n_dropped"]) == ("\n".join(kept), len(t.split("\n")) - len(kept))
    small = spark.createDataFrame([(1, "menu\none", "tiny", 1, 2, 3), (2, "menu\ntwo", "tiny", 1, 2, 3), (3, "menu\nthree", "lone", 1, 2, 3)], "doc_id long, text string, host string, drop int, page int, kept int")
    assert {r["doc_id"]: (r["clean"], r["drop"], r["page"], r["kept"]) for r in lines.dedup_lines(small).collect()} == {1: ("one", 1, 2, 3), 2: ("two", 1, 2, 3), 3: ("menu\nthree", 1, 2, 3)}
    long = spark.createDataFrame([(k, "menu\n" + "\n".join(f"{k} {i}" for i in range(50_000)), "h") for k in range(3)], "doc_id long, text string, host string")
    assert {r["n_dropped"] for r in lines.dedup_lines(long).select("n_dropped").collect()} == {1}
    plain = odd.withColumnRenamed("source", "host")
    assert lines.dedup_lines(plain).count() == len(ODD) and lines.dedup_lines(plain.limit(0)).count() == 0


# 10 -----------------------------------------------------------------------------------------------


def brute_components(rows):
    sets, parent = collections.defaultdict(list), {}
    for doc, text in rows:
        if doc is not None:
            parent[doc], own = doc, plain_words(text or "")
            sets[doc].append({tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(d, s) for d, many in sets.items() for s in many if s]
    for i, (a, s) in enumerate(own):
        for b, t in own[:i]:
            if 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def near_copies(rng, n):
    rows, base = [], [text_of(rng, rng.randint(3, 120)).split() for _ in range(25)]
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(99)}"
        rows.append((k, rng.choice([" ", "\n"]).join(words).upper() if k % 9 == 0 else " ".join(words)))
    return rows


def test_near_duplicates_match_brute_force(spark, odd, monkeypatch):
    rows = near_copies(random.Random(10), 400) + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (905, "x y"), (905, "one"), (None, "one")]
    want = brute_components(rows)
    for block, star in ((1000, 2000), (7, 3)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "CLUSTER_BLOCK", block)
        monkeypatch.setattr(neardup, "STAR", star)
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert neardup.near_duplicates(odd).count() == len(ODD)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_a_large_group_around_the_threshold_makes_linear_rows(spark, monkeypatch):
    rng = random.Random(16)
    base = text_of(rng, 200).split()
    rows = []
    for k in range(1500):  # pairs of copies are now above the threshold, now below
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 4, 5, 6, 7, 9])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    written = []
    kept = neardup.materialize_at

    def counted(df, name):
        out = kept(df, name)
        written.append((name, out[0].count()))
        return out

    monkeypatch.setattr(neardup, "materialize_at", counted)
    monkeypatch.setattr(neardup, "BLOCK", 400)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 400)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    blocks = -(-1500 // 400)
    for name, n in written:
        # a forest of each pair of blocks, in at most all bands
        assert n <= 1500 * neardup.BANDS * (blocks + 1), name
    assert dict(written)["star-pairs"] <= 1500 * neardup.BANDS and dict(written)["cluster-links"] <= 1500 * blocks


def test_shingle_hashes_tell_sets():
    rng = random.Random(11)
    for _ in range(50):
        own = neardup.words(text_of(rng, rng.randint(0, 60), 1))
        assert len(np.unique(neardup.shingle_hashes(own))) == len(neardup.shingle_set(b" ".join(own).decode()))
