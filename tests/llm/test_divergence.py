"""Terms against a regular expression and the library's hash; divergences against a plain calculation in whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from roiscore.llm import divergence, terms
from roiscore.llm.divergence import Params, divergences, shares

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall((text or "").encode())]


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", words_of(text)) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for _, _, ws in own for w in set(ws))
        kept = [w for w, n in held.items() if n >= least]
        groups = {s: Counter(w for _, source, ws in own if source == s for w in ws) for s in {d[1] for d in own}}

        def share(counts):
            of = sum(counts[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // of for w in kept}

        whole = share(sum(groups.values(), Counter()))
        p = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in groups if o != s]
            stand = [(-((p[s][w] - whole[w]) ** 2 // whole[w]), w) for w in kept if groups[s][w] and p[s][w] > whole[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(stand)[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def run(spark, table, **params):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "doc_id long, text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergences(df, params=Params(**params)).collect())


def corpus(n, seed=1):
    rng = random.Random(seed)
    stock = ["the", "The", "été", "straße", "x", "don't", "a1b", "日本語", "w" * 40, "W" * 40, "of it", "--", "42", "Ω"] + [f"t{chr(97 + k)}" for k in range(9)]
    lang, source = ["en", "de", None, ""], ["s0"] * 6 + ["s1", "s2", None, "s3", "é"]
    return [(rng.randrange(20), rng.choice([None, "", " ".join(rng.choices(stock, k=rng.randrange(30)))]) if rng.random() < 0.2 else " ".join(rng.choices(stock, k=rng.randrange(60))), rng.choice(lang), rng.choice(source)) for _ in range(n)]


@pytest.mark.parametrize("width", range(32))
def test_hash_is_that_of_the_library(width):
    rows = np.random.default_rng(width).integers(0, 256, (50, width), dtype=np.uint8)
    assert [xxhash.xxh64_intdigest(r.tobytes()) for r in rows] == terms.xxh64(rows).tolist()


@pytest.mark.parametrize("hashed", [terms.xxh64, lambda rows: np.zeros(len(rows), np.uint64)])
def test_slices_of_one_hash_are_parted_by_bytes(hashed):
    words = [b"a", b"b", b"a", b"ab", b"ba", b"ab", b"z" * 31, b"z" * 32, b"z" * 33, b"z" * 32, b"y" * 40]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    stands, number = terms.distinct(data, ends - [len(w) for w in words], ends, hashed)
    assert [words[stands[k]] for k in number] == words and len(stands) == len(set(words))


def test_terms_are_those_of_the_pattern():
    texts = ["Élan VITAL x1y", "", "\x00@[`{\x7fAZ az", "日本 Ä", "a" * 100 + " B"]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, data)])
    found, term, group, n, docs = terms.term_counts(np.frombuffer(b"".join(data), np.uint8), bounds, np.arange(len(texts)))
    got = Counter({(int(g), found[int(t)].as_py()): int(k) for t, g, k in zip(term, group, n)})
    assert got == Counter((g, w) for g, t in enumerate(texts) for w in words_of(t)) and set(docs) == {1}


def test_parts_of_a_document_cut_no_term():
    data = np.frombuffer(b"abc " * 50 + b"x" * 90 + b" yz", np.uint8)
    parts = [p.tobytes() for p in terms.pieces(data, 7)]
    assert b"".join(parts) == data.tobytes() and sum((TERM.findall(p) for p in parts), []) == TERM.findall(data.tobytes())


def test_shares_are_exact_for_large_counts():
    for count, of in [(0, 1), (0, 3), (10**12, 10**12 + 7), (8 * 10**15, 9 * 10**15 - 1), (7, 10**10)]:
        assert shares(np.array([count]), np.array([of]))[0] == 1 + 10**9 * (count + 1) // of


def test_all_rows_against_a_plain_calculation(spark):
    rows = corpus(300)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, top=3, least_docs=5) == brute(rows, 5, 3)


def test_blocks_of_sources_buckets_of_terms_and_the_join_by_shuffle(spark, monkeypatch):
    rows = corpus(300, 2)
    monkeypatch.setattr(divergence, "STRETCH", 3)
    assert run(spark, rows, block=2, rows=5, most_broadcast=0) == brute(rows)


def test_one_source_with_most_rows_and_copies(spark):
    rows = corpus(60, 3) + [(7, "the same text again", "en", "s0")] * 400
    assert run(spark, rows) == brute(rows)


def test_long_documents_count_once_for_all_their_parts(spark):
    rows = [(k, "abc de f " * 400 + f"own{chr(97 + k)}", "en", f"s{k % 2}") for k in range(3)] + [(9, "abc", "en", "s1")]
    assert run(spark, rows, slice_bytes=500) == brute(rows)


def test_groups_without_terms_and_empty_tables(spark):
    rows = [(1, None, None, "a"), (2, "1 2 3", "", "b"), (3, "x", "en", "a"), (4, "x y", "en", None)]
    assert run(spark, rows) == brute(rows) and ("", "a", "pair", "b", 0, 1) in run(spark, rows)
    assert run(spark, []) == []
