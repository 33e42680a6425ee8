"""A corpus of documents made ready for training: toxic ones go, one of each group of near copies stays, repeated passages
and personal data are replaced, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept. All but the last return the
columns of `documents` as they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiscore.llm.common import cut_counted, read_table, remove, scope, shared_dir, staged
from roiscore.llm.jaccard import similar_documents
from roiscore.llm.packing import pack_documents
from roiscore.llm.pii import replace_entities
from roiscore.llm.queries import SURROGATE_POLICY, WORD_TOKENIZER
from roiscore.llm.repeats import remove_repeats
from roiscore.llm.toxicity import fit, learnable, score_documents

#: Documents of this score or more are rejected as toxic.
TOXIC = 0.5

#: SQL can express neither of the stages; tests compare them with brute force.
ORACLE_SQL = None


#: Numbers of near copies that may be broadcast (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _others(docs: DataFrame) -> list[str]:
    """The columns that the operators do not hand through themselves."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _documents(df: DataFrame, docs: DataFrame, text, changed) -> DataFrame:
    """The columns of docs; texts that have changed have another length."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(changed, F.char_length(text)).otherwise(F.col("carried.n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*((new[c] if c in new else F.col(f"carried.`{c}`")).cast(kind).alias(c) for c, kind in docs.dtypes))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score at which a document counts as toxic, as they are.

    Null or empty texts are scored like any text without a toxic passage; rows with null or equal ids are judged one by one
    (a null id has no label to learn from); columns of any name come back untouched; an empty table gives no rows.
    """
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels").where(learnable())), carry=docs.columns)
    return scored.where(F.col("score") < TOXIC).select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that are near copies, the one with the smallest id, as it is.

    Rows are numbered once, and groups and decisions go by that number: rows that share an id are different rows, of which
    each stays or goes with its own text; of equal ids in one group one row stays; null ids come last. Rows with null or
    empty texts, or texts without words, are copies of nothing and stay. Columns of any name come back untouched; an empty table gives no rows.
    """
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried")))
    found = similar_documents(numbered.select("row", "carried.doc_id", "carried.text"), id_col="row", carry=["doc_id"])
    first = F.min(F.struct(F.col("carried.doc_id").isNull().alias("unnamed"), "carried.doc_id", F.col("doc_id").alias("row")))
    stay = found.groupBy("component_id").agg(first.alias("first")).select("first.row")
    go, n = cut_counted(numbered.select("row").join(stay, "row", "left_anti"))
    return numbered.join(F.broadcast(go) if n <= MOST_BROADCAST else go, "row", "left_anti").select("carried.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that occur earlier; a text that loses words has the others joined by spaces, all others stay as they are.

    A null text comes back empty; rows that share an id, or have none, are documents of their own, in the order of a hash of id and text; rows equal
    in both keep or lose the same words; columns of any name come back untouched (but `n_chars`, which follows the text); an empty table gives no rows.
    """
    changed = F.col("n_removed") > 0
    return _documents(remove_repeats(docs, carry=_others(docs)), docs, F.when(changed, F.col("kept")).otherwise(F.col("text")), changed)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data; texts without any stay as they are.

    A null text comes back empty; rows with null or equal ids are rewritten one by one; columns of any name come back untouched
    (but `n_chars`, which follows the text); an empty table gives no rows.
    """
    return _documents(replace_entities(docs, SURROGATE_POLICY, carry=_others(docs)), docs, F.col("text"), F.size("entities") > 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is one piece, its end id; rows with null or equal ids are packed one by one; other columns are not
    read; an empty table gives no rows.
    """
    return pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read back. What a stage has staged, and the result before it, are removed once it is written."""
    docs = read_table(spark, sf_dir, "documents")
    folder, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs
