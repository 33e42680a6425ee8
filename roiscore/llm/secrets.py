"""Secret scanning: candidates by pattern, and a random forest, trained from labelled findings, that removes false positives."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roiscore.llm.common import cut, id_and_text, staged

#: Labelled findings that the forest is grown on, at most (as expected under hashing of their places and values).
MOST_LABELLED = 20_000
#: Most frequent words of the corpus that make up the dictionary; it is broadcast, so its size is fixed.
DICTIONARY_WORDS = 10_000
TREES, DEPTH, SEED = 30, 6, 11

_BLANK = r"[\x20\x09-\x0D]+"
_VALUE = r"([A-Za-z0-9+/_\-]{16,}={0,2})"
_CREDENTIAL = r"(?i)(token|secret|password|passwd|pwd|api_?key|access_?key|auth|bearer|credential)s?"
_ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abp]-|^sk-[A-Za-z0-9]{20,}|^AIza[A-Za-z0-9_\-]{35}$"
_HARMLESS = r"(?i)^[0-9]+$|example|x{5,}|0{8,}|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_DIGEST_OF = r"(?i)(sha-?[0-9]+|md5|commit|checksum|digest|etag|uuid)\W*$"
FEATURES = ["length", "digits", "capitals", "hex", "distinct", "transitions", "repeats", "covered", "path_kind", "path_depth", "path_bucket", "named", "assigned", "quoted", "before_length", "before_bucket", "after_length"]


def candidates(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, word, value, lead, before, after, path): every run of 16 or more characters of keys, one of them a digit.

    A word may hold several such runs. word is the word's number in the text, lead what stands before the value in its word, from
    the run before it on (so that the name before a sign of assignment is part of it), before the two words before, after
    the next one. Only texts with such a run are cut into words.
    """
    docs = id_and_text(docs.withColumn("_path", path), id_col, text_col, ["_path"]).where(F.col("text").rlike(r"[A-Za-z0-9+/_\-]{16}"))
    words = docs.select("doc_id", F.col("carried._path").alias("path"), F.split("text", _BLANK).alias("words"))
    runs = lambda w: F.regexp_extract_all(w, F.lit(_VALUE), F.lit(1))
    digit = lambda v: v.rlike("[0-9]")
    at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    holds = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("word"), w.alias("w"))), lambda x: (F.char_length(x["w"]) >= 16) & F.exists(runs(x["w"]), digit))
    near = F.transform(holds, lambda x: F.struct(x["word"].cast("long").alias("word"), x["w"].alias("w"), F.concat_ws(" ", F.get("words", x["word"] - 2), F.get("words", x["word"] - 1)).alias("before"), at(x["word"] + 1).alias("after")))
    found = words.select("doc_id", "path", F.explode(near).alias("x"))
    # what lies between the runs: one more than there are runs, the first before all of them
    parted = found.select("doc_id", "path", "x.word", "x.before", "x.after", runs(F.col("x.w")).alias("runs"), F.split("x.w", _VALUE).alias("gaps"))
    each = F.transform("runs", lambda v, i: F.struct(v.alias("value"), F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.get("gaps", i)).alias("lead")))
    found = parted.select("doc_id", "path", "word", "before", "after", F.explode(F.filter(each, lambda x: digit(x["value"]))).alias("x"))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "word", "x.value", "x.lead", "before", "after", F.coalesce("path", F.lit("")).alias("path"))


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The most frequent words of four to twelve letters, counted over all texts."""
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`")), r"[^\p{L}]+")).alias("run")).where(F.char_length("run").between(4, 12))
    return words.groupBy("run").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "run").limit(DICTIONARY_WORDS).select("run", F.lit(1).alias("known"))


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.char_length(value)


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with the forest's features: length, character transitions, dictionary coverage, path, neighbouring words."""
    runs = found.select("row", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"[\p{L}]{4,12}"), F.lit(0))).alias("run"))
    covered = runs.join(F.broadcast(words), "run").groupBy("row").agg(F.sum(F.char_length("run")).alias("letters"))
    value, context = F.col("value"), F.concat_ws(" ", "before", "lead")
    change = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    columns = {
        "length": F.char_length(value),
        "digits": _share(value, "[0-9]"),
        "capitals": _share(value, "[A-Z]"),
        "hex": _share(value, "[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.char_length(value),
        "transitions": F.regexp_count(value, F.lit(change)) / F.char_length(value),
        "repeats": _share(value, r"(.)(?=\1)"),
        "covered": F.coalesce("letters", F.lit(0)) / F.char_length(value),
        "path_kind": F.col("path").rlike(r"(?i)test|example|sample|spec|fixture|docs?/|readme").cast("int"),
        "path_depth": F.regexp_count("path", F.lit("[/.]")),
        "path_bucket": F.pmod(F.xxhash64("path"), F.lit(64)),
        "named": context.rlike(_CREDENTIAL).cast("int"),
        "assigned": context.rlike(r"[=:]\W*$").cast("int"),
        "quoted": F.col("lead").rlike("[\"'`]$").cast("int"),
        "before_length": F.char_length("before"),
        "before_bucket": F.pmod(F.xxhash64(F.lower(F.substring_index("before", " ", -1))), F.lit(64)),
        "after_length": F.char_length("after"),
    }
    return found.join(covered, "row", "left").select("row", "doc_id", "word", "value", "lead", "before", *(c.cast("double").alias(k) for k, c in columns.items()))


def rule_labels(found: DataFrame) -> DataFrame:
    """(row, secret) of the candidates that rules can tell: issued key formats and values assigned to a credential's name are secrets; bare
    numbers, placeholders, UUIDs and named digests are not. The others stay without a label, for the forest to decide."""
    context = F.concat_ws(" ", "before", "lead")
    secret = F.when(F.col("value").rlike(_ISSUED), 1).when(F.col("value").rlike(_HARMLESS) | context.rlike(_DIGEST_OF), 0).when(context.rlike(_CREDENTIAL + r"\W*[=:]\W*$"), 1)
    return found.select("row", secret.alias("secret")).where("secret is not null")


def find_secrets(docs: DataFrame, path: Column, labels=rule_labels, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, value, score, is_secret) of every candidate in every text; a word has a row for each of its candidates.

    labels: a function from the candidates to (row, secret) of the labelled ones. A share of these, chosen by hash and
    expected to be MOST_LABELLED at most, trains the forest; all candidates are scored by it.

    Null or empty texts have no candidates; rows with equal or null ids keep theirs; null paths are empty. With labels of one kind
    alone every score is that label, without labels 0. A table without candidates gives no rows; extra columns are not read.
    """
    found = staged(candidates(docs, path, id_col, text_col))
    rows = staged(featured(found, dictionary(docs, text_col)))
    known = cut(labels(found).dropDuplicates(["row"]).where("secret is not null"))
    kinds = {r.secret: r.n for r in known.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    out = ("doc_id", "word", "value")
    if len(kinds) < 2:
        only = float(next(iter(kinds), 0))
        return rows.select(*out, F.lit(only).alias("score"), F.lit(only >= threshold).alias("is_secret"))
    share = min(1.0, MOST_LABELLED / sum(kinds.values()))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    sample = rows.join(known, "row").where(F.pmod(F.xxhash64("doc_id", "word", "value", "lead", "before"), F.lit(1 << 20)) < int((1 << 20) * share))
    sample = vectors.transform(sample.select("row", *FEATURES, F.col("secret").cast("double").alias("label"))).select("row", "features", "label").repartition(4, "row").sortWithinPartitions("row")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, cacheNodeIds=False).fit(cut(sample))
    scored = forest.transform(vectors.transform(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.select(*out, "score", (F.col("score") >= threshold).alias("is_secret"))
