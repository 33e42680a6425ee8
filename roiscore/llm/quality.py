"""Quality rules: counts of the text itself, and the log-likelihood ratio of hashed n-grams between a trusted target and the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiscore.llm.common import cut, id_and_text

#: Buckets of hashed n-grams; the model is one number for each.
BUCKETS = 1 << 16
#: Added to the count of every bucket, in both distributions.
SMOOTHING = 1.0
#: Mean log-likelihood ratio of an n-gram below which a document is not kept.
LEAST_RATIO = -0.6

#: Ids of trusted documents that may be broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"
#: The lower half of a hash, where a window's place stands while windows are sorted.
_LOWER = (1 << 32) - 1


def _words(text: Column) -> Column:
    return F.when(F.btrim(text, F.lit(_BLANKS)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(_BLANKS)), r"[\x20\x09-\x0D]+"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once in each row."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """Hashes of the windows of three words."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _repeated(windows: Column) -> Column:
    """Words that lie in a window which the text holds twice or more; windows is a column that has been computed before.

    Places are sorted as plain numbers below the upper halves of their hashes; only those beside an equal half are sorted by whole hashes.
    """

    def candidates(keys: Column) -> Column:
        alike = lambda k, i: F.shiftright(F.get(keys, i).bitwiseXOR(k), 32) == 0
        return F.transform(F.filter(keys, lambda k, i: alike(k, i - 1) | alike(k, i + 1)), lambda k: k.bitwiseAND(F.lit(_LOWER)).cast("int"))

    def covered(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]))
        places = F.sort_array(F.transform(same, lambda p: p["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    keys = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~_LOWER)).bitwiseOR(i.cast("long"))))
    pairs = F.array_sort(F.transform(_let(keys, candidates), lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(pairs, covered)).otherwise(0)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and further columns made of the column `text`; words lie between ASCII blanks. Null text is empty and has none of anything."""
    docs = id_and_text(docs, id_col, text_col).select("doc_id", *(v.alias(k) for k, v in more.items()), _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"), F.regexp_count("text", F.lit(_SYMBOLS)).alias("symbols"))
    docs = docs.withColumn("windows", _windows(F.col("words")))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.concat_ws("", "words")),
        "n_symbols": F.col("symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated(F.col("windows")),
    }
    return docs.select("doc_id", *(v.cast("long").alias(k) for k, v in counts.items()), *more)


def _tokens() -> Column:
    """Of the column `text`: its words and runs of signs."""
    return F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))


def _bucket(*tokens) -> Column:
    return F.pmod(F.xxhash64(*tokens), F.lit(BUCKETS)).cast("int")


def _exploded(docs: DataFrame, keep: str) -> DataFrame:
    """The column `keep` and the bucket of every unigram and bigram; the last bigram has its token alone. Each token is a row with the next one, so that hashes are made in compiled code."""
    tokens = docs.select(keep, _tokens().alias("one"))
    after = F.slice("one", 2, F.greatest(F.size("one") - 1, F.lit(0))).alias("two")
    places = tokens.select(keep, F.inline(F.arrays_zip("one", after)).alias("one", "two"))
    return places.select(keep, F.explode(F.array(_bucket("one"), _bucket("one", "two"))).alias("bucket"))


def _mean(ratios: Column) -> Column:
    """Of the column `text`: the mean of its n-grams' ratios, 0 without any."""
    of_places = _let(_tokens(), lambda t: F.transform(t, lambda x, i: F.get(ratios, _bucket(x)) + F.get(ratios, _bucket(x, F.get(t, i + 1)))))
    return _let(of_places, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, r: a + r) / (2 * F.size(x))).otherwise(0.0))


def ratio_model(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, ratio): the logarithm of each bucket's probability in the target over that in all documents; BUCKETS rows at any size.

    target: the ids of trusted documents (a null or repeated id adds nothing). All n-grams of all documents are counted;
    counts are added up within tasks before they are shuffled.
    """
    trusted = cut(target.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct().withColumn("trusted", F.lit(1)))
    few = trusted.count() <= MOST_BROADCAST
    marked = id_and_text(docs, id_col, text_col).join(F.broadcast(trusted) if few else trusted, "doc_id", "left")
    grams = _exploded(marked.withColumn("trusted", F.coalesce("trusted", F.lit(0))), "trusted")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    smooth = cut(every.select("bucket", *((F.coalesce(c, F.lit(0)) + SMOOTHING).alias(c) for c in ("raw", "good"))))
    total = smooth.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    return smooth.select("bucket", (F.log(F.col("good") / total.good) - F.log(F.col("raw") / total.raw)).alias("ratio"))


def quality(docs: DataFrame, target: DataFrame, least_ratio: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed, kept) of every document.

    ratio is the mean, over the document's n-grams, of the log-likelihood ratio between the trusted target's multinomial and
    the whole corpus's; a document is kept if it has 50 words or more, no more than half of them in repeated
    windows of three, and a ratio of least_ratio or more.

    Null or empty texts have no words and fail; a document without n-grams has the ratio 0. Without trusted documents
    the target is the smoothing alone. Rows with equal or null ids are kept; an empty table gives no rows; extra columns are not read.
    """
    # BUCKETS numbers at any size, so they go into the plan as one value and every text is scored where it is read
    model = ratio_model(docs, target, id_col, text_col).orderBy("bucket").collect()
    ratios = F.split(F.lit(",".join(repr(r.ratio) for r in model)), ",").cast("array<double>")
    scored = text_counts(docs, id_col, text_col, ratio=_mean(ratios))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio))
