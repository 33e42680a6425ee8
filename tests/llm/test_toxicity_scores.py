"""Scores of documents against plain Python: counts by strings instead of buckets, and segments by trying all of them."""

import math
import random
import re
from collections import Counter

import pytest

from roiscore.llm import toxicity
from roiscore.llm.toxicity import DOUBT, DRIFT, STEM_BYTES, STEM_PRIOR, TOP, WORD_PRIOR


def tokens(text):
    text = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"(?:[^\x00-\x7f]|[0-9A-Za-z])+", text)]


def maximal(scores, at=0):
    """The best segment (of equal ones the first, then the shortest), and what lies on either side of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > 0 and (best is None or total > best[0] + 1e-12):
                best = total, i, j
    if best is None:
        return []
    total, i, j = best
    return maximal(scores[:i], at) + [total] + maximal(scores[j:], at + j)


@pytest.mark.parametrize("seed", range(2))
def test_scores_against_plain_python(spark, seed):
    rng = random.Random(seed)
    clean, vile = [f"word{chr(97 + k)}" for k in range(12)] + ["Été", "DON'T", "naïve"], ["Vilest", "vileness", "RUDE", "schändlich"]
    rows = [(k, " ".join(rng.choices(clean + vile * (k % 3 == 0), k=rng.randrange(2, 30)))) for k in range(90)] + [(200, None), (201, ""), (202, "!!! ...")]
    labels = [(k, int(k % 3 == 0)) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))

    counts = {kind: (Counter(), Counter()) for kind in ("word", "stem")}
    for text, toxic in {(text, dict(labels)[k]) for k, text in rows if k in dict(labels)}:
        for w in set(tokens(text)):
            counts["word"][toxic][w] += 1
        for w in {w[:STEM_BYTES] for w in tokens(text)}:
            counts["stem"][toxic][w] += 1
    held = [sum(c.values()) for c in counts["word"]]
    share = held[1] / sum(held)
    assert model.share == pytest.approx(share) and model.toxic == pytest.approx(sum(t for _, t in labels) / 70, abs=0.02)

    def odds(w):
        c0, c1 = (counts["stem"][k][w[:STEM_BYTES]] for k in (0, 1))
        both = WORD_PRIOR / (c0 + c1 + STEM_PRIOR)
        good = counts["word"][0][w] + both * (c0 + STEM_PRIOR * (1 - share))
        bad = counts["word"][1][w] + both * (c1 + STEM_PRIOR * share)
        return min(max(math.log(bad / good) - math.log(share / (1 - share)) - DOUBT * math.sqrt(1 / bad + 1 / good) - DRIFT, -DRIFT), TOP)

    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        found = tokens(text)
        totals = maximal([odds(w) for w in found])
        level = math.log(model.scale * len(found)) if totals else 0
        excess = [max(0.0, model.rate * s - level) for s in totals] or [0.0]
        x = math.log1p(sum(excess)), math.log1p(max(excess)), math.log1p(len(found))
        expected = 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x)))))
        assert got[k].score == pytest.approx(expected, rel=1e-5, abs=1e-7)
        significant = [s for s in totals if math.log(model.scale * len(found)) - model.rate * s < math.log(toxicity.EXPECTED)]
        assert [p.score for p in got[k].passages] == pytest.approx(significant, rel=1e-5)


def test_carried_texts_go_to_python_once(spark):
    """Null texts and other columns come back as they are, and scores are those of texts that are not carried."""
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    rows = [(1, "vile words", 7), (2, "calm sea", None), (3, "vile vile", 1), (4, "", 2), (5, None, 3), (None, "calm vile \u00e9", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int")
    model = toxicity.fit(docs, labels)
    carried = toxicity.score_documents(docs, model, carry=docs.columns)
    plain = toxicity.score_documents(docs, model, carry=["more"])
    got = {r.carried.more: (r.doc_id, r.score, r.passages) for r in carried.collect()}
    assert got == {r.carried.more: (r.doc_id, r.score, r.passages) for r in plain.collect()}
    assert sorted(map(repr, (tuple(r.carried) for r in carried.collect()))) == sorted(map(repr, rows))
    assert len(carried._jdf.queryExecution().analyzed().children().head().output().mkString(" ").split()) == 2
