"""Text operators against brute force on small drawn corpora, with null, empty, long, tied and repeated rows."""

import collections
import hashlib
import itertools
import random
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from roiscore.llm import common, components, jaccard, packing, pieces, pii, quality, repeats, toxicity, words
from roiscore.llm.components import connected

WORD, PIECE = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, key long, v long, cls string, carried int"


def corpus(seed=0, n=120):
    """Texts with shared passages, copies, near copies, odd characters, and rows with null or repeated ids."""
    rnd = random.Random(seed)
    vocab = ["alpha", "beta", "Gamma", "delta", "die", "été", "漢字", "x" * 40, "🙂", "it's", "10,5", "a|b", "ß", "İ", "Σ"] + [f"w{i}" for i in range(60)]
    sep = [" ", " ", " ", "\n", "\t", "  ", "\x0b"]
    text = lambda k: "".join(rnd.choice(vocab) + rnd.choice(sep) for _ in range(k))
    passages = [text(30) for _ in range(3)]
    out = []
    for i in range(n):
        t = text(rnd.choice([0, 1, 3, 4, 5, 19, 20, 21, 60, 150]))
        if rnd.random() < 0.3:
            t += rnd.choice(passages) + text(5)
        if out and rnd.random() < 0.3:
            w = (rnd.choice(out)[1] or "").split(" ")
            if rnd.random() < 0.7 and w:
                w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append([i, t])
    out += [[n, None], [n + 1, ""], [n + 2, " \n "], [n + 3, "word " * 3000], [None, out[5][1]], [5, out[5][1]]]
    rnd.shuffle(out)
    return [(i, t, "en", 1, 2, "c", 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_hashes_follow_words_and_documents():
    texts = ["one two", "two", "", "t wo", "one  two\n", "ONE two"]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, first = words.spans(data, bounds)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == b"one two two t wo one two ONE two".split() and np.diff(first).tolist() == [2, 1, 0, 2, 2, 2]
    h = words.hashes(data, starts, ends)
    assert h[1] == h[2] == h[6] and h[0] == h[5] and len({*h.tolist()}) == 5
    assert words.runs(h, 2)[0] == words.runs(h, 2)[5]


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    out = packing.pack_documents(docs, WORD, capacity=64, grain=8, most_open=4).collect()
    by = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    expected = collections.defaultdict(list)
    for i, t in rows:
        expected[i].append(tokenizer.encode(t, add_special_tokens=False).ids + [2])
    for i, texts in expected.items():
        assert sum(r.length for r in by[i]) == sum(map(len, texts))
        if len(texts) == 1:
            ids = [x for r in sorted(by[i], key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
            assert ids == texts[0] and all(r.doc_tokens == len(ids) for r in by[i])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4 > 0
            at += r.length
        assert at <= 64 and at & (at - 1) == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, WORD, capacity=100)


def test_frequent_words_stay_known_as_rare_ones_go(monkeypatch):
    tokenizer, encoded = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    monkeypatch.setattr(tokenizer, "MOST_WORDS", 3)
    real = tokenizer.known.encoded
    tokenizer.known.encoded = lambda word: encoded.append(word) or real(word)
    texts = [f"the Caf\u00e9, rare{k} w\u00f6rd{k}... x{k}" for k in range(40)]
    whole = tokenizer.known.tokenizer
    for text in texts:
        want = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokenizer.ids([text.encode()]) == [want]
    assert encoded.count(b"the") == 1 and len(tokenizer.known) + len(tokenizer.known.older) < 30


def test_packing_prefers_the_least_sum_of_squares():
    p = packing.Packer(64, 8, 100, 0)
    ids = lambda n: b"\0" * 4 * n
    p.add(1, ids(20))
    p.add(2, ids(44))  # fills the open window exactly
    assert [(r[0], r[4], r[5]) for r in p.rows] == [(1, 0, 0), (2, 0, 20)] and p.count.sum() == 0
    p.add(3, ids(20))
    p.add(4, ids(20))  # a second window of that level would cost 3, joining costs 0
    assert p.count.sum() == 1 and p.count[40 // 8] == 1


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    parts = ["a", "The", "É", "é", " ", "\n", "'s", "'", "漢", "🙂", "Σ", "İ", "ß", "=", "0", "12", "̀", "\x00", "<|endoftext|>", ".", "!!", "ª", "\xa0", "\x85", "\x1c", "ǅ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    library = Tokenizer.from_file(WORD)
    got = packing.WordTokenizer(WORD).ids([t.encode() for t in texts])
    assert all(np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


def test_pieces_equal_the_library(docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted((str(r.doc_id), bytes(r.ids), r.decoded) for r in pieces.encode_decode(docs, PIECE).collect())
    ids = [(i, model.encode(t, add_bos=True, add_eos=True)) for i, t in rows]
    assert got == sorted((str(i), np.array(x, "<u4").tobytes(), model.decode(x)) for i, x in ids)


def test_long_words_take_linear_time():
    tokenizer = pieces.PieceTokenizer(PIECE)
    rnd = random.Random(8)

    def seconds(text):
        began = time.perf_counter()
        ids = tokenizer.encode([text])[0]
        spent = time.perf_counter() - began
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.model.encode(text)
        return spent

    for make in (lambda n: "the" * n, lambda n: "a" * n, lambda n: "ab" * n, lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))):
        short = min(seconds(make(15_000)) for _ in range(3))
        assert min(seconds(make(60_000)) for _ in range(2)) < 8 * short + 0.1


def test_pieces_of_drawn_words_equal_the_library():
    tokenizer, rnd = pieces.PieceTokenizer(PIECE), random.Random(12)
    known = [tokenizer.model.id_to_piece(i) for i in range(300, tokenizer.size)]

    def word():
        kind = rnd.random()
        if kind < 0.3:
            return "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 40)))
        if kind < 0.6:
            return "".join(rnd.choice(known).replace("▁", rnd.choice(["", " "])) for _ in range(rnd.randint(1, 6)))
        if kind < 0.8:
            return rnd.choice(["the", "a", "ab", "ing", "aa", "ha", "00", "==", "--", "lol", ". ", "eee", "er"]) * rnd.randint(1, 60)
        return "".join(chr(rnd.randint(32, 0x3000)) for _ in range(rnd.randint(1, 20)))

    texts = [" ".join(word() for _ in range(rnd.randint(1, 6))) for _ in range(4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(texts)] == tokenizer.model.encode(texts)


def test_pieces_of_odd_texts():
    import sentencepiece

    rnd = random.Random(1)
    parts = ["a", "aa", "the", " ", "   ", "\n", "é", "漢", "🙂", "▁", "==", "0", "̀", "\x00", "<s>", "<0x0A>", "ing", "İ", "\xa0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(3000)] + ["", "a" * 5000, " " * 3000, "ab" * 3000, "=" * 4097]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert [np.frombuffer(x, "<u4").tolist() for x in pieces.PieceTokenizer(PIECE).encode(texts)] == model.encode(texts)


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = [*range(len(rows))]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return sorted(((name, len(sets[i]), least.get(root(i), name)) for i, (name, _) in enumerate(rows)), key=str)


def test_jaccard_against_brute_force(docs, rows):
    got = jaccard.similar_documents(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_of_many_near_copies(spark, seed):
    """A group in which many pairs share rare shingles without linking, a chain, and links that only the original has."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(60)] = f"n{rnd.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 50))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("most", [jaccard.MOST_BROADCAST, -1])
def test_jaccard_of_null_ids(spark, monkeypatch, most):
    """A near copy with a null id, a chain over one, and two near copies without any id."""
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", most)
    run = lambda c, at: " ".join(f"{c}{k}" for k in range(at, at + 50))
    rows = [(7, run("a", 0)), (None, run("a", 3)), (10, run("b", 0)), (None, run("b", 4)), (12, run("b", 8)), (None, run("d", 0)), (None, run("d", 2)), (20, run("e", 0))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str)
    assert got == brute_components(rows) == sorted([(7, 46, 7), (None, 46, 7), (10, 46, 10), (None, 46, 10), (12, 46, 10), (None, 46, None), (None, 46, None), (20, 46, 20)], key=str)
    links, _ = jaccard.linked_pairs(df)
    assert sorted(map(tuple, links.collect()), key=str) == sorted([(7, None), (10, None), (12, None), (None, None)], key=str)


def test_jaccard_beyond_the_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", -1)
    assert sorted(map(tuple, jaccard.similar_documents(docs).collect()), key=str) == brute_components(rows)


def test_jaccard_with_hot_keys_dealt_out(spark, docs, rows, monkeypatch):
    """Lists, hubs, components and copies of more than a few rows are dealt out over several tasks."""
    for module in (common, jaccard):
        monkeypatch.setattr(module, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    more = docs.unionByName(docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 1000))
    expected = brute_components(rows + [(i + 1000, t) for i, t in rows if i is not None and i < 10])
    assert sorted(map(tuple, jaccard.similar_documents(more, longest=3).collect()), key=str) == expected


def test_jaccard_of_a_long_chain_and_of_empty_tables(spark):
    """Near copies of near copies, and a list in which the hub links with nothing."""
    rows = [(i, " ".join(f"c{k}" for k in range(5 * i, 5 * i + 60))) for i in range(40)]
    rows += [(100 + i, " ".join([f"own{i}w{k}" for k in range(4)] + [f"s{k}" for k in range(30 if i else 12)])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str) == brute_components(rows)
    assert jaccard.similar_documents(df.where("doc_id < 0"), carry=["doc_id"]).collect() == []
    assert jaccard.similar_documents(spark.createDataFrame([(1, None), (None, " ")], "doc_id long, text string")).collect() == [(1, 0, 1), (None, 0, None)]


def test_all_links(docs, rows):
    links, members = jaccard.linked_pairs(docs)
    own = dict(map(tuple, members.where("doc_id is not null").collect()))
    by = {frozenset(s): own[i] for i, s in ((i, shingles(t)) for i, t in rows) if i is not None and s}
    sets = list(by)
    expected = {(min(by[a], by[b]), max(by[a], by[b])) for k, a in enumerate(sets) for b in sets[:k] if 100 * len(a & b) >= 75 * len(a | b)}
    got = links.collect()
    assert len(got) == len({*map(tuple, got)}) and {*map(tuple, got)} == expected and expected


@pytest.mark.parametrize("most", [components.TASK_EDGES, 3, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (None, 3), (30, 31), (31, 32), (32, 30), (2, 1)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 30: 30, 31: 30, 32: 30}
    assert connected(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_components_of_drawn_graphs(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 10)
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 40)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def brute_repeats(rows, n=20):
    """Documents go by id, those that share an id by the hash of id and text; a null id comes last."""
    last = (1 << 63) - 1

    def key(i, t):
        i = last if i is None else i
        seed = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        return i, (xxhash.xxh64_intdigest(t.encode(), seed) + (1 << 63)) % (1 << 64)  # as Spark compares it, signed

    first = {}
    for i, t in sorted(rows, key=lambda r: key(*r)):
        w = t.encode().split()
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), (key(i, t), s))
    out = []
    for i, t in rows:
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (key(i, t), s):
                gone.update(range(s, s + n))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("flush", [200, 500_000])
def test_repeats_against_brute_force(docs, rows, monkeypatch, flush):
    monkeypatch.setattr(repeats, "FLUSH_WINDOWS", flush)
    monkeypatch.setattr(repeats, "RANGE_WINDOWS", flush)
    got = repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


@pytest.mark.parametrize("flush", [100, 500_000])
def test_repeats_of_shared_ids(spark, monkeypatch, flush):
    """Rows that share an id, or have none, are documents of their own: of other lengths, with other repeats, and with passages at one start."""
    monkeypatch.setattr(repeats, "FLUSH_WINDOWS", flush)
    monkeypatch.setattr(repeats, "RANGE_WINDOWS", flush)
    rnd = random.Random(11)
    passages = [" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(60)) for c in "abc"]
    fresh = lambda k: " ".join(f"f{rnd.randrange(10**9)}" for _ in range(k))
    rows = [(1, passages[0]), (5, f"{fresh(50)} {passages[0]}"), (5, "short text only"), (5, fresh(80)), (None, "")]
    rows += [(rnd.choice([5, None]), f"{passages[rnd.randrange(3)]} {fresh(rnd.randrange(30))}") for _ in range(30)]
    rows += rows[-6:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
    assert all(r.n_removed == 0 for r in got if r.n_words in (3, 80))


def test_a_flush_makes_rows_of_occupied_ranges_alone():
    """Millions of ranges cost a flush no more than the windows it holds."""
    task = {}
    holder = type("Docs", (), {"mapInArrow": lambda self, f, schema: task.setdefault("run", f)})()
    repeats._anchors(holder, 10, 1 << 20)
    rng = np.random.default_rng(0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([" ".join(map(str, rng.integers(0, 1000, 300))) for _ in range(100)])], names=["key", "text"])
    began = time.perf_counter()
    (rows,) = task["run"](iter([batch]))
    assert time.perf_counter() - began < 2 and rows.num_rows <= 100 * 291
    assert sum(len(x) for x in rows.column(1).to_pylist()) == 4 * 100 * 291 and rows.column(0).to_pylist() == sorted({*rows.column(0).to_pylist()})


def test_repeats_carry_other_columns(docs, rows):
    got = repeats.remove_repeats(docs, carry=["lang", "key", "v"]).select("doc_id", "text", "carried.*").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in rows) and {(r.lang, r.key, r.v) for r in got} == {("en", 1, 2)}


def test_quality_counts_against_brute_force(docs, rows):
    got = quality.quality(docs, docs.where("doc_id % 2 = 0")).collect()
    expected = []
    for i, t in rows:
        w = t.encode().split()
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        expected.append((i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), len(covered)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(expected, key=str)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.ratio >= quality.LEAST_RATIO) for r in got)


def test_quality_ratio_against_brute_force(spark, docs, rows):
    grams = lambda t: [*regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+", t)]

    def buckets(t):
        out = []
        for a, b in itertools.zip_longest(grams(t), grams(t)[1:]):
            one = xxhash.xxh64(a.encode(), seed=42).intdigest()
            two = xxhash.xxh64(b.encode(), seed=one).intdigest() if b is not None else one
            out += [(x if x < 1 << 63 else x - (1 << 64)) % quality.BUCKETS for x in (one, two)]
        return out

    trusted = {i for i, _ in rows if i is not None and i % 2 == 0}
    raw, good = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in rows:
        np.add.at(raw, buckets(t), 1)
        if i in trusted:
            np.add.at(good, buckets(t), 1)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    expected = [(str(i), round(float(ratio[buckets(t)].mean()) if grams(t) else 0.0, 9)) for i, t in rows]
    got = quality.quality(docs, docs.where("doc_id % 2 = 0").select("doc_id")).select("doc_id", "ratio").collect()
    assert sorted((str(r.doc_id), round(r.ratio, 9)) for r in got) == sorted(expected)


def test_quality_hashes_are_compiled_and_windows_compared_whole(spark, docs):
    """No function is called for each token where n-grams are counted; windows that share half a hash only are not the same."""
    plan = quality._exploded(docs.selectExpr("1 as trusted", "text"), "trusted")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    h = (-5 << 32) + 7
    given = [([h, h + 1, h + 2], 0), ([h, h + 1, 9, h], 6), ([h + 1, h, h + 1, h + 2, h + 1], 7), ([3, 3 + (1 << 32), 3], 5), ([], 0), ([h], 0)]
    rows = spark.createDataFrame([(n, w) for n, (w, _) in enumerate(given)], "n int, windows array<long>")
    assert {r.n: r.found for r in rows.select("n", quality._repeated(F.col("windows")).alias("found")).collect()} == {n: x for n, (_, x) in enumerate(given)}


def test_quality_ratio_tells_junk(spark):
    rnd = random.Random(2)
    plain = [" ".join(rnd.choice(["the", "of", "and", "river", "house", "green"]) + f"{rnd.randrange(300)}" for _ in range(80)) for _ in range(60)]
    junk = [" | ".join(rnd.choice(["buy", "now", "cheap"]) + f"{rnd.randrange(300)}" for _ in range(80)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(plain + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.quality(df, df.where("doc_id < 40")).collect()}
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 80))


def test_segments_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        scores = [rnd.uniform(-2, 1.5) for _ in range(rnd.randint(0, 25))]

        def split(a, b):
            """All maximal segments: the best one, and those of what lies before and after."""
            total, i, j = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, a, a))
            return [*split(a, i), (i, j, pytest.approx(total)), *split(j, b)] if total > 0 else []

        assert toxicity.segments(np.array(scores)) == split(0, len(scores))


def test_segments_of_a_long_text_take_linear_steps():
    """Starts that fall all along, as in ordinary text, in which nothing joins."""
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line" and frame.f_code is toxicity.segments.__code__
        return count

    n = 20_000
    scores = np.where(np.arange(n) % 25 == 0, 1.0, -0.25)
    before = sys.gettrace()
    sys.settrace(count)
    try:
        found = toxicity.segments(scores)
    finally:
        sys.settrace(before)
    assert found == [(i, i + 1, 1.0) for i in range(0, n, 25)]
    assert 0 < steps < n


def test_toxicity_learns_and_handles_odd_tables(spark, docs):
    rnd = random.Random(7)
    plain, bad = [f"word{i}" for i in range(80)], ["vile", "Scum!", "trash"]
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(plain) for _ in range(rnd.randint(20, 120))]
        if i % 4 == 0:
            at = rnd.randrange(len(w))
            w[at:at] = [rnd.choice(bad) for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab.where(toxicity.learnable()))
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in held) and 0 < len(held) < 400
    hit = got[0]
    assert hit.passages and rows[0][1].encode()[hit.passages[0].start : hit.passages[0].end].decode().split()[0] in bad
    odd = toxicity.score_documents(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score < 0.5 for r in odd)
    for none in (lab.where("toxic = 0"), lab.where("false")):
        assert {r.score for r in toxicity.score_documents(df, toxicity.fit(df, none)).collect()} == {0.0}


def test_toxicity_of_repeated_ids(spark, monkeypatch):
    """Each text counts once, whatever its id, and no more texts than the bound are learnt from; nearly all of them may be toxic."""
    rows = [(1, f"text number {i} vile") for i in range(300)] * 2 + [(i, f"clean words {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 0), *((i, 0) for i in range(2, 60))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.toxic == 300 / 358 and model.words.sum() == 4 * 300 + 3 * 58
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs.dropDuplicates(["doc_id"]), model).collect()}
    assert scores[1] > 0.5 > scores[2]
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 100)
    assert 50 < toxicity.fit(docs, labels).words[1].max() < 150
    only = toxicity.Model(np.array([[0.0, 1e6]] * 2, np.float32), np.array([[0.0], [1e6]], np.float32), 1 - 1e-6)
    assert np.isfinite(only.token_scores(np.array([0, 1]), np.array([0, 0]))).all()


POLICY = pii.Policy(b"test key")
PRIVATE = "Dear Mr. John Smith, call +1 (017) 555-7713 or J.Smith@Mail.Example.com; Smith paid with 4929348385146306 from 97.51.17.173, IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789. Frau Müller und Herr Иван Петров."


def test_entities_are_found_and_replaced_in_kind(spark):
    df = spark.createDataFrame([(1, PRIVATE), (2, "mail j.smith@mail.example.com, card 4929 3483 8514 6306, v4.0.1 of 2024-01-02"), (3, None), (None, "Version 4.0.1")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(df, POLICY).collect()}
    kinds = [e.kind for e in got[1].entities]
    assert kinds == ["NAME", "NAME", "PHONE", "EMAIL", "NAME", "CARD", "IP", "IBAN", "SSN", "NAME", "NAME", "NAME"]
    new = got[1].text
    for private in ("John", "Smith", "555-7713", "Example", "4929348385146306", "97.51.17.173", "DE89", "123-45-6789", "Müller", "Иван", "Петров"):
        assert private not in new
    by = {e.kind: e.surrogate for e in got[1].entities}
    assert got[1].entities[1].surrogate == got[1].entities[4].surrogate  # the surname again, without a title
    assert by["PHONE"].startswith("+1 (") and len(by["PHONE"]) == len("+1 (017) 555-7713")
    assert pii._luhn(by["CARD"]) % 10 == 0 and pii._iban_rest(by["IBAN"].replace(" ", "")) == 1 and by["IBAN"].startswith("DE") and by["IBAN"][4] == " "
    assert got[1].entities[-1].surrogate[0].isupper() and "а" <= got[1].entities[-1].surrogate[-1] <= "я"
    second = {e.kind: e.surrogate for e in got[2].entities}
    assert second["EMAIL"].lower() == by["EMAIL"].lower() and second["CARD"].replace(" ", "") == by["CARD"] and second["CARD"].count(" ") == 3
    assert got[2].text.endswith("v4.0.1 of 2024-01-02") and got[3].text == "" and got[None].text == "Version 4.0.1"
    assert pii.replace_entities(df.limit(0), POLICY).count() == 0


@pytest.mark.parametrize("text, expected", [
    ("Señora Ana María García López llegó. García y López", ["f Ana", "f María", "s García", "s López", "s García", "s López"]),
    ("Herr Otto von Bismarck sprach, und Bismarck ging", ["m Otto", "s Bismarck", "s Bismarck"]),
    ("Herr von der Leyen; Sr. Juan de la Cruz Pérez", ["s Leyen", "m Juan", "s Cruz", "s Pérez"]),
    ("Dr. Wei Li came. Li said; Lin did not", ["n Wei", "s Li", "s Li"]),
    ("Prof. 王, Dr. 李 : 王 , 李 .", ["s 王", "s 李", "s 王", "s 李"]),
    ("Prof. J. R. R. Tolkien wrote R. Tolkien", ["n J", "n R", "n R", "s Tolkien", "s Tolkien"]),
    ("Dr. Ahmed bin Salem al-Rashid, Mr. d'Artagnan went", ["n Ahmed", "s Salem", "s al-Rashid", "s d'Artagnan"]),
    ("weil Herr Müller das Auto von Frau Schmidt sah", ["s Müller", "s Schmidt"]),
    ("Mr. Josef K. went", ["m Josef", "s K"]),
    ("Mr. John Smith paid", ["m John", "s Smith"]),
])
def test_whole_names_are_found(text, expected):
    assert [f"{style} {text[a:b]}" for a, b, _, _, style in pii.detect(text)] == expected


@pytest.mark.parametrize("text, expected", [
    ("IBAN BE68 5390 0754 7034 BIC GEBABEBB", "IBAN BE68 5390 0754 7034"),
    ("ES91 2100 0418 4502 0005 1332 ON TIME", "IBAN ES91 2100 0418 4502 0005 1332"),
    ("card 4111 1111 1111 1111 123, next", "CARD 4111 1111 1111 1111"),
    ("order 12 4111-1111-1111-1111", "CARD 4111-1111-1111-1111"),
    ("3782 822463 10005 12/27", "CARD 3782 822463 10005"),
    ("49 2934 8385146306", "CARD 49 2934 8385146306"),
    ("ids 4111111111111111 5500000000000004", "CARD 4111111111111111|CARD 5500000000000004"),
    ("4111 1111 1111 1112 and 0000 0000 0000 0000 and BE68 5390 0754 7035 BIC", ""),
    ("1 4 11111111111111 1 and 12 34 56 78 90 12 34 56", ""),
])
def test_numbers_among_others_are_found(text, expected):
    assert "|".join(f"{kind} {text[a:b]}" for a, b, kind, _, _ in pii.detect(text)) == expected


def test_replacements_stay_distinct(spark, monkeypatch):
    """With a drawing that often collides, every entity still gets its own replacement, and none that stands in the corpus."""
    entities = [("SSN", f"{i:09d}", "s") for i in range(40)]

    def crowded(key, kind, canonical, attempt=0, style="s"):
        return f"{(int(canonical) * 7 + attempt * 13) % 97 % (30 if attempt < 2 else 997):09d}"

    monkeypatch.setattr(pii, "surrogate", crowded)
    df = spark.createDataFrame(entities, "kind string, canonical string, style string")
    tries = {r.canonical: r.attempt for r in pii._tries(df, POLICY).collect()}
    new = [crowded(b"", "SSN", c, tries.get(c, 0)) for _, c, _ in entities]
    assert tries and len({*new}) == 40 and not {*new} & {c for _, c, _ in entities}


def test_one_entity_has_one_replacement(spark):
    texts = {
        1: "Mr Alex Smith met Dr Alex Brown. Alex agreed, and Alex's friend too.",
        2: "Dr Alex Smith called +1 555 123 4567, then 555-123-4567 and (555) 123-4567.",
        3: "Ring +44 20 7946 0958 or +44 (020) 7946 0958; at 172.16.9.1, 172.40.9.1, 10.0.0.1, 192.168.4.4, 127.0.0.1.",
        4: "Frau Kim Lee and Mrs Kim Roe; pay with 4929348385146306",
        5: "x" * 80 + "@host.example.com",
    }
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame([*texts.items()], "doc_id long, text string"), POLICY).collect()}
    surface = lambda i: [(texts[i][e.start : e.end], e.surrogate) for e in got[i].entities]
    alex = {new for i in (1, 2) for old, new in surface(i) if old == "Alex"}
    assert len(alex) == 1 and sum(old == "Alex" for old, _ in surface(1)) == 4 and "Alex" not in got[1].text
    assert alex.pop()[-1] in "ntsk"  # one title says a man, none a woman
    assert {new for old, new in surface(4) if old == "Kim"}.pop()[-1] == "a"
    number = {new.removeprefix("+1 ").translate({ord(c): None for c in " -()"}) for old, new in surface(2) if "555" in old}
    assert len(number) == 1 and surface(2)[2][1].startswith("+1 ")
    (a, b), ips = (new for old, new in surface(3)[:2]), [new for _, new in surface(3)[2:]]
    assert a.startswith("+44 ") and b.startswith("+44 (0") and a[4:].replace(" ", "") == b[6:].replace(") ", "").replace(" ", "")
    assert ips[0].startswith("172.") and 16 <= int(ips[0].split(".")[1]) < 32 and int(ips[1].split(".")[0]) >= 240
    assert [x.split(".")[0] for x in ips[2:]] == ["10", "192", "127"]
    card = surface(4)[-1][1]
    assert card.startswith("400000") and pii._luhn(card) % 10 == 0
    assert got[5].entities[0].start == 0 and "x" * 9 not in got[5].text


def test_many_entities_take_linear_time():
    def seconds(text):
        began = time.perf_counter()
        pii.detect(text)
        return time.perf_counter() - began

    for one in ("mail a{0}@b{0}.example.com now. ", "Mr. Aa{0}x met Mr. Bb{0}y. "):
        short, long = ("".join(one.format(i) for i in range(n)) for n in (1000, 4000))
        assert min(seconds(long) for _ in range(3)) < 8 * min(seconds(short) for _ in range(3)) + 0.05


def test_overlapping_entities_keep_the_first_found():
    rnd = random.Random(4)
    for _ in range(300):
        lists = []
        for _ in range(3):
            starts = sorted(rnd.sample(range(60), 12))
            lists.append([(a, a + rnd.randint(1, 6), "X", "", "") for a in starts])
        kept, plain = [], []
        for own in lists:
            kept = pii._with(kept, own)
            for s in own:
                if all(s[1] <= t[0] or t[1] <= s[0] for t in plain):
                    plain.append(s)
        assert kept == sorted(plain)


def test_replacement_beyond_the_broadcast(docs, monkeypatch):
    once = sorted(map(str, pii.replace_entities(docs, POLICY, carry=["lang"]).collect()))
    monkeypatch.setattr(pii, "MOST_BROADCAST", -1)
    assert sorted(map(str, pii.replace_entities(docs, POLICY, carry=["lang"]).collect())) == once


@pytest.mark.parametrize("operator", [
    lambda d: packing.pack_documents(d, WORD), lambda d: pieces.encode_decode(d, PIECE), jaccard.similar_documents, repeats.remove_repeats,
    lambda d: quality.quality(d, d), lambda d: toxicity.score_documents(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))), lambda d: pii.replace_entities(d, POLICY),
])
def test_empty_tables(docs, operator):
    assert operator(docs.limit(0)).count() == 0


def test_digest_columns(spark):
    ids = np.array([1, 70000, 2], "<u4").tobytes()
    row = spark.createDataFrame([(bytearray(ids), "é")], "ids binary, text string").select(F.crc32("ids").alias("c"), F.sha2("ids", 256).alias("s"), F.sha2(F.col("text").cast("binary"), 256).alias("t")).first()
    assert (row.c, row.s, row.t) == (zlib.crc32(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256("é".encode()).hexdigest())
