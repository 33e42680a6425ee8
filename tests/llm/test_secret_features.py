"""The features of candidates for secrets, against plain Python on drawn texts."""

import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from roiscore.llm import secrets

CHANGE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")


def bucket(text):
    value = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return (value if value < 1 << 63 else value - (1 << 64)) % 64


def plain(value, lead, before, after, path, known):
    n = len(value)
    context = before + " " + lead
    share = lambda pattern: len(re.findall(pattern, value)) / n
    letters = sum(len(run) for run in re.findall(r"[^\W\d_]{4,12}", value.lower()) if run in known)
    return {
        "length": n, "digits": share("[0-9]"), "capitals": share("[A-Z]"), "hex": share("[0-9a-f]"), "distinct": len(set(value)) / n, "transitions": len(CHANGE.findall(value)) / n,
        "repeats": share(r"(.)(?=\1)"), "covered": letters / n, "path_kind": bool(re.search(r"(?i)test|example|sample|spec|fixture|docs?/|readme", path)), "path_depth": len(re.findall("[/.]", path)),
        "path_bucket": bucket(path), "named": bool(re.search(secrets._CREDENTIAL, context)), "assigned": bool(re.search(r"[=:]\W*$", context)), "quoted": bool(re.search("[\"'`]$", lead)),
        "before_length": len(before), "before_bucket": bucket(before.split(" ")[-1].lower()), "after_length": len(after),
    }


def test_features_against_plain_python(spark):
    rng = random.Random(9)
    words = ["the", "password", "token", "value", "example", "some", "words", "is", "commit"]
    signs = "abcdefXYZ0123456789-_/+"
    rows = []
    for k in range(120):
        key = "".join(rng.choices(signs, k=rng.randrange(16, 50))) + rng.choice(["0", "7"]) + rng.choice(["", "word", "password"])
        lead = rng.choice(["", "api_key=", 'secret:"', "x", "(", "sha256:"])
        lead = lead if not lead or not lead[-1].isalnum() else lead + "="
        rows.append((k, f"{' '.join(rng.choices(words, k=rng.randrange(0, 4)))} {lead}{key} {rng.choice(words)}".strip(), rng.choice(["a/b.txt", "docs/example.md", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = secrets.candidates(df, F.col("path"))
    counted = Counter(w for _, t, _ in rows for w in re.split(r"[\W\d_]+", t.lower()) if 4 <= len(w) <= 12)
    known = {w for w, n in counted.items() if n >= 5}
    assert {r.run for r in secrets.dictionary(df).collect()} == known
    got = secrets.featured(found, secrets.dictionary(df)).collect()
    about = {(r.doc_id, r.word, r.value): (r.lead, r.before, r.after, r.path) for r in found.collect()}
    assert len(got) == len(about) >= 120
    for r in got:
        expected = plain(r.value, *about[r.doc_id, r.word, r.value], known)
        assert {k: round(r[k], 12) for k in secrets.FEATURES} == {k: round(float(v), 12) for k, v in expected.items()}
