"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiscore.llm import words
from roiscore.llm.common import cut, id_and_text, staged, text_slices, with_carried
from roiscore.llm.sums import COLUMNS, added, parts

#: Labelled rows that the model is fitted on, at most (as expected under hashing of their ids).
MOST_LABELLED = 50_000
WORD_BITS, STEM_BITS, STEM_BYTES = 20, 16, 6
#: Strength of the Dirichlet priors of a word (centred on its stem) and of a stem (centred on the corpus).
WORD_PRIOR, STEM_PRIOR = 2.0, 10.0
#: Posterior deviations taken off a log-odds, what every token costs, and the bounds of a token's score.
DOUBT, DRIFT, TOP = 1.64, 0.25, 6.0
#: A segment is significant if clean text of this length gives fewer than so many such segments.
EXPECTED = 0.05

_SPLIT = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, stem bucket, start, end, first token of each document) of runs of letters and digits, Latin capitals in lower case."""
    data = words.lower(data)
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][capital] += 0x20
    starts, ends, first = words.spans(data, bounds, _SPLIT)
    word = words.hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)
    stem = words.hashes(data, starts, np.minimum(ends, starts + STEM_BYTES)) >> np.uint64(64 - STEM_BITS)
    return word.astype(np.int64), stem.astype(np.int64), starts, ends, first


@dataclass
class Model:
    """Counts of documents by token bucket, and the calibration; its size does not grow with the corpus."""

    words: np.ndarray  # 2 x buckets: clean and toxic documents that hold the word
    stems: np.ndarray
    share: float  # of tokens that come from toxic documents
    rate: float = 1.0  # of the extreme-value law
    scale: float = 1.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    toxic: float = 0.0  # share of toxic labels

    def token_scores(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        clean, toxic = self.stems[0][stem], self.stems[1][stem]
        both = WORD_PRIOR / (clean + toxic + STEM_PRIOR)  # neither share is taken as 1 less the other, which may round to 0
        toxic, clean = self.words[1][word] + both * (toxic + STEM_PRIOR * self.share), self.words[0][word] + both * (clean + STEM_PRIOR * (1 - self.share))
        odds = np.log(toxic / clean) - np.log(self.share / (1 - self.share))
        return np.clip(odds - DOUBT * np.sqrt(1 / toxic + 1 / clean) - DRIFT, -DRIFT, TOP)

    def features(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, float, float]:
        """Sum of the segments' scores and the best one, each above what clean text of this length reaches, and the length."""
        if not segments:
            return 0.0, 0.0, np.log1p(n)
        level = np.log(self.scale * n)
        excess = [max(0.0, self.rate * s - level) for _, _, s in segments]
        return np.log1p(sum(excess)), np.log1p(max(excess)), np.log1p(n)

    def score(self, features: np.ndarray) -> np.ndarray:
        if not 0 < self.toxic < 1:
            return np.full(len(features), self.toxic)
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights[1:]) + self.weights[0], -40, 40)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments of positive total, as (first, after the last, total), by one scan over the scores.

    Each positive score starts a segment; it joins back to the latest kept segment that begins lower and ends lower, as
    long as there is one. Scores that are not positive only move the running total. Each kept segment knows the latest one
    before it that begins lower, so what a search has passed over is not looked at again.
    """
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    kept: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        first, after, low, high = at, at + 1, float(total[at]), float(total[at + 1])
        k = len(kept) - 1
        while k >= 0 and kept[k][2] >= low:
            k = kept[k][4]
        while k >= 0 and kept[k][3] < high:
            first, _, low, _, lower = kept[k]
            del kept[k:]
            k = lower
        kept.append((first, after, low, high, k))
    return [(f, a, h - l) for f, a, l, h, _ in kept]


def _counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of both labels (column `toxic`) by word bucket and by stem bucket, added up over all tasks."""
    n_words, n_stems = 1 << WORD_BITS, 1 << STEM_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n_words + n_stems), np.uint32)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for first, stop, data, bounds in text_slices(batch.column(0)):
                word, stem, _, _, at = _tokens(data, bounds)
                toxic = np.repeat(label[first:stop], np.diff(at)).astype(np.int64)
                owner = np.repeat(np.arange(stop - first), np.diff(at))
                for bucket, size, base in ((word, n_words, 0), (stem, n_stems, n_words)):
                    _, once = np.unique(owner * size + bucket, return_index=True)
                    for k in (0, 1):
                        sums[k, base : base + size] += np.bincount(bucket[once][toxic[once] == k], minlength=size).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts(sums), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "places", "counts"])

    total = added(docs.select("text", "toxic").mapInArrow(count, COLUMNS), 2 * (n_words + n_stems)).reshape(2, -1)
    return total[:, :n_words].copy(), total[:, n_words:].copy()


def _rate(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of the mean of exp(rate * score) = 1 under the clean tokens' scores."""
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * np.exp(mid * scores)).sum() < weight.sum() else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model learnt from labelled documents: every label given, or a share chosen by hash of the id that is expected to be
    MOST_LABELLED rows. Equal texts with equal labels count once; where ids repeat so often that there are more texts
    than that, a share of them is chosen by hash of the text. Only sums of fixed size and three figures of each
    text in that sample reach the driver.

    Null ids and labels are left out; of several labels of one id the larger counts, for every row with that id. Without both labels, every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = labels.count()
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, MOST_LABELLED / max(1, known)))
    labelled = docs.join(F.broadcast(sample), "doc_id").withColumn("hash", F.xxhash64("text"))
    texts = labelled.select("hash", "toxic").distinct().count()
    chosen = F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < (1 << 20) * min(1.0, MOST_LABELLED / max(1, texts))
    train = staged(labelled.where(chosen).dropDuplicates(["hash", "toxic"]).select("text", "toxic"))
    by_word, by_stem = _counts(train)
    size = by_word.sum(axis=1)
    model = Model(by_word, by_stem, float(np.clip(size[1] / max(size.sum(), 1), 1e-6, 1 - 1e-6)))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, tokens, best and total segment score, histogram of token scores) of each training document."""
        model = shared.value
        for batch in batches:
            rows = []
            label = batch.column(1).to_numpy()
            for first, stop, data, bounds in text_slices(batch.column(0)):
                word, stem, _, _, at = _tokens(data, bounds)
                scores = model.token_scores(word, stem)
                for k in range(stop - first):
                    own = scores[at[k] : at[k + 1]]
                    found = segments(own)
                    bins = np.bincount(np.floor((own + DRIFT) / (TOP + DRIFT) * 63.999).astype(np.int64), minlength=64)
                    rows.append((int(label[first + k]), len(own), [s for _, _, s in found], bins.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())))], names=["toxic", "n", "segments", "bins"])

    measured = cut(train.mapInArrow(measure, "toxic int, n long, segments array<double>, bins array<long>"))
    labelled = measured.agg(F.count("*"), F.sum("toxic")).first()
    if not labelled[0]:
        return model
    model.toxic = labelled[1] / labelled[0]
    if not 0 < model.toxic < 1:
        return model
    bins = measured.where("toxic = 0").select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    middle = (np.array([r.bin for r in bins]) + 0.5) / 64 * (TOP + DRIFT) - DRIFT
    weight = np.array([float(r.n) for r in bins])
    middle[middle < -DRIFT + 0.1] = -DRIFT  # nearly all tokens lie on the bound
    model.rate = _rate(middle, weight)
    # K of the law: as many segments above twice the drift's reach as clean documents of this length really have
    cutoff = 2.0
    clean = measured.where("toxic = 0").agg(F.sum(F.expr(f"size(filter(segments, s -> s >= {cutoff}))")).alias("found"), F.sum("n").alias("tokens")).first()
    model.scale = float(max(clean.found, 1) / max(clean.tokens, 1) * np.exp(model.rate * cutoff))
    rows = measured.select("toxic", "n", "segments").toLocalIterator()
    y, x = zip(*((r.toxic, model.features([(0, 0, s) for s in r.segments], r.n)) for r in rows))
    model.weights = _logistic(np.array(x), np.array(y, float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a small ridge, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (len(w) - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, score, passages): the probability that a document is toxic, and every significant toxic passage as start and end
    (bytes of the UTF-8 text), its score and the natural logarithm of how many such passages clean text of this length would have.

    Whole texts are scored row by row, without a shuffle. Null or empty texts have no passage and the score of a text of
    length 0. Rows with equal or null ids are kept; an empty table gives no rows; extra columns are not read, but those in
    `carry` go along as the struct column `carried`.
    """
    own = list(carry).index(text_col) if carry and text_col in carry and dict(docs.dtypes)[text_col] == "string" else None
    docs = id_and_text(docs, id_col, text_col, carry)
    if own is not None:  # the text goes to the Python workers once, as a carried field
        docs = docs.drop("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_expected", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rest = shared.value, 2 if own is None else 1
        for batch in batches:
            text = batch.column(1) if own is None else batch.column(1).field(own).fill_null("")
            for first, stop, data, bounds in text_slices(text):
                word, stem, starts, ends, at = _tokens(data, bounds)
                scores = model.token_scores(word, stem)
                positive = np.concatenate([[0], np.cumsum(scores > 0)])[at]
                features, passages = [], []
                for k in range(stop - first):
                    a, n = int(at[k]), int(at[k + 1] - at[k])
                    found = segments(scores[a : a + n]) if positive[k + 1] > positive[k] else []
                    features.append(model.features(found, n))
                    level = [(f, e, s, np.log(model.scale * n) - model.rate * s) for f, e, s in found]
                    passages.append([{"start": int(starts[a + f] - bounds[k]), "end": int(ends[a + e - 1] - bounds[k]), "score": s, "log_expected": float(x)} for f, e, s, x in level if x < np.log(EXPECTED)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(model.score(np.array(features).reshape(-1, 3)), pa.float64()), pa.array(passages, passage), *(c.slice(first, stop - first) for c in batch.columns[rest:])], names=["doc_id", "score", "passages", *batch.schema.names[rest:]])

    return docs.mapInArrow(score, with_carried("doc_id long, score double, passages array<struct<start: long, end: long, score: double, log_expected: double>>", docs))


def learnable(id_col: str = "doc_id"):
    """Rows whose labels may be learnt: all but those that are held out for judging."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(True))
