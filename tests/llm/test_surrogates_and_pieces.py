"""Surrogates where ranges are full, planted personal data of many forms, pieces of words that repeat a few symbols, and the suffix filter of the join."""

import itertools
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest

from roiscore.llm import jaccard, pii
from roiscore.llm.pieces import PieceTokenizer
from roiscore.llm.pii import Policy, detect, replace_entities, surrogate

POLICY = Policy(b"k")


def test_a_range_that_is_full_ends(spark):
    """All phone numbers of one national digit are there; each still gets a number of its own that is none of them."""
    rows = [(k, f"call +991 00 0{k} now, or +991 00 {k}0") for k in range(1, 10)]
    found = replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), POLICY).collect()
    before = {s[3] for _, t in rows for s in detect(t)}
    new = [e.surrogate for r in found for e in r.entities]
    national = [pii._national(x) for x in new]
    assert len(new) == 18 and len(set(national)) == 18 and not set(national) & before
    assert all(x.startswith("+991") for x in new)


@pytest.mark.parametrize("kind, canonical", [("PHONE", "7"), ("PHONE", "5551234567"), ("SSN", "123456789"), ("IP", "8.8.8.8"), ("IP", "10.0.0.1"), ("EMAIL", "a@b.com"), ("CARD", "4111111111111111"), ("IBAN", "GB82WEST12345698765432"), ("IP6", "2001:db8::1"), ("NAME", "smith"), ("NAME", "иван")])
def test_later_attempts_draw_from_ever_wider_ranges(kind, canonical):
    lengths = [len(surrogate(b"k", kind, canonical, attempt)) for attempt in (0, 30, 40)]
    assert lengths[0] < lengths[1] < lengths[2]
    assert surrogate(b"k", kind, canonical, 35) == surrogate(b"k", kind, canonical, 35) != surrogate(b"k", kind, canonical, 34)


def test_given_names_keep_their_gender_in_other_scripts():
    assert surrogate(b"k", "NAME", "иван", 0, "m")[-1] in "нрт" and surrogate(b"k", "NAME", "мария", 0, "f")[-1] in "ая"
    assert surrogate(b"k", "NAME", "γιωργος", 0, "m")[-1] == "ς" and surrogate(b"k", "NAME", "ελενη", 0, "f")[-1] in "αη"


PLANTED = {
    "NAME": ["Mr Smith", "Mrs. Jane Roe", "MR SMITH", "DR. JONES", "Dr.Smith", "Herr Müller", "Señora García", "Госпожа Иванова", "Κύριος Παππάς", "Prof. van der Berg"],
    "PHONE": ["+44 20 7946 0958", "(555) 123-4567", "555-123-4567", "0171 2345678", "030 1234567", "+1 (212) 555-0100", "0621 45 67 89"],
    "SSN": ["123-45-6789", "SSN 123456789", "SSN: 987654321"],
    "IP": ["8.8.4.4", "192.168.0.1"],
    "IP6": ["2001:db8::ff00:42:8329", "fe80::1", "2001:0db8:0000:0000:0000:ff00:0042:8329"],
    "EMAIL": ["a.b+c@d-e.org", "X@Y.COM"],
    "CARD": ["4111 1111 1111 1111", "378282246310005"],
    "IBAN": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
}
CLEAN = ["at 12:30:45 on 2024-01-02", "std::abs and a::b", "version 1.2.3.4.5", "pages 100-200, 300", "THE SIR AND THE MADAM", "a ratio of 3:2:1", "order 0001 2345678", "12345678", "0.171 2345678", "HE SAW IT"]


def test_planted_data_is_found_and_clean_text_is_left():
    rng = random.Random(1)
    hits = total = 0
    for kind, forms in PLANTED.items():
        for form in forms:
            for _ in range(5):
                before, after = (" ".join(rng.choices(["so", "we", "met", "there", "then"], k=5)) for _ in range(2))
                found = [s for s in detect(f"{before} {form} {after}.") if s[2] == kind]
                hits, total = hits + bool(found), total + 1
    assert hits == total
    assert not [(t, detect(t)) for t in CLEAN if detect(t)]


def test_names_in_capitals_end_before_common_words():
    text = "YESTERDAY MR JOHN SMITH AND DR. JONES SAID THAT MRS ROE WAS HERE"
    assert [text[a:b] for a, b, *_ in detect(text)] == ["JOHN", "SMITH", "JONES", "ROE"]


def test_formats_of_new_kinds_stay(spark):
    text = "SSN 123456789, 0171 2345678, fe80::1, Dr.Smith and MR SMITH"
    new = replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), POLICY).first().text
    m = re.fullmatch(r"SSN (9\d{8}), 0(\d{3}) (\d{7}), (2001:db8:\S+), Dr\.([A-Z][a-z]+) and MR ([A-Z]+)", new)
    assert m and m[5].upper() == m[6] and m[5] != "Smith"


@pytest.fixture(scope="module")
def tokenizer():
    return PieceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))


def exact(tokenizer, words):
    began = time.perf_counter()
    found = [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode(words)]
    seconds = time.perf_counter() - began
    assert found == tokenizer.model.encode(words)
    return seconds


@pytest.mark.parametrize("unit", ["-=", "=-", "ab", "abc", "-", "-=*", "é=", "the", "=-=", "()[]", "…-"])
def test_long_periodic_words_take_few_rounds(tokenizer, unit):
    assert exact(tokenizer, [unit * (60_000 // len(unit))]) < 3


def test_alternations_of_all_punctuation(tokenizer):
    marks = [c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c in tokenizer.chars]
    words = [(a + b) * 300 for a, b in itertools.permutations(marks, 2)]
    assert exact(tokenizer, words) < 60


def test_periodic_words_with_random_ends(tokenizer):
    rng = random.Random(2)
    alphabet = "abcdefgéü-=. _"
    words = ["".join(rng.choices(alphabet, k=rng.randrange(1, 5))) * rng.randrange(1, 80) + "".join(rng.choices(alphabet, k=rng.randrange(15))) for _ in range(1500)]
    exact(tokenizer, words)


def test_suffix_filter_bounds_what_sets_differ_by():
    rng = np.random.default_rng(3)
    for _ in range(500):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 200), rng.integers(0, 120)).astype(np.uint64)) for _ in range(2))
        differ = len(np.setxor1d(a, b))
        bounds = [jaccard._apart(a, b, depth) for depth in range(8)]
        assert bounds == sorted(bounds) and bounds[-1] <= differ and bounds[0] == abs(len(a) - len(b))
        union = len(np.union1d(a, b))
        assert jaccard._linked(a, b, 75) == (4 * (union - differ) >= 3 * union)
    apart = np.arange(0, 400, 2, dtype=np.uint64), np.arange(1, 401, 2, dtype=np.uint64)
    assert jaccard._apart(*apart) > jaccard._apart(*apart, depth=0) == 0
