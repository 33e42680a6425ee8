"""Audit of sources: how far the words of each source of a language lie from those of every other source, and which words stand out.

Terms are counted in tasks (`terms`), shares of terms are whole numbers in parts of a thousand million, and the divergence of
two sources is a sum of whole numbers over all terms that their language keeps; nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roiscore.llm.common import dealt_join, hot_keys, small_batches, staged, text_slices
from roiscore.llm.terms import pieces, term_counts
from roiscore.session import ship


@dataclass(frozen=True)
class Params:
    #: Documents of its language that must hold a term for it to be kept.
    least_docs: int = 3
    #: Ranks of single terms that are given for a source.
    top: int = 200
    #: Text that is taken apart at a time; a longer document goes in parts.
    slice_bytes: int = 1 << 22
    #: Sources in a block of the matrix of pairs.
    block: int = 256
    #: Counts that one group of the matrix work reads, about.
    rows: int = 500_000
    #: Sources that may be broadcast to the counts; more are joined by a shuffle.
    most_broadcast: int = 100_000


#: Terms in a dense stretch of the matrix.
STRETCH = 2048
_COUNTS = "lang binary, source binary, term binary, n long, docs long"
_PAIRS = "lang binary, source binary, item binary, value long"


def _counts(params: Params):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(terms, term, lang, source, n, docs):
            return pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(term)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            lang, source, text = batch.column(0), batch.column(1), batch.column(2)
            known: dict[tuple[bytes, bytes], int] = {}
            group = np.array([known.setdefault(x, len(known)) for x in zip(lang.to_pylist(), source.to_pylist())], np.int64)
            langs, sources = (pa.array(x, pa.binary()) for x in zip(*known)) if known else (lang, source)
            none = np.zeros(len(known), np.int64)
            yield rows(pa.array([b""], pa.binary()), none, langs, sources, none, none)  # says that the group occurs
            for first, stop, data, bounds in text_slices(text, params.slice_bytes):
                if len(data) > 2 * params.slice_bytes:  # one long document: its parts are added up before it counts as one
                    own = [pa.table({"term": terms.take(pa.array(term)), "n": n}) for part in pieces(data, params.slice_bytes) for terms, term, _, n, _ in [term_counts(part, np.array([0, len(part)]), np.zeros(1, np.int64))]]
                    total = pa.concat_tables(own).group_by("term", use_threads=False).aggregate([("n", "sum")])
                    g = pa.array(np.full(len(total), group[first]))
                    yield rows(total["term"].combine_chunks(), np.arange(len(total)), langs.take(g), sources.take(g), total["n_sum"].to_numpy(), np.ones(len(total), np.int64))
                else:
                    terms, term, g, n, docs = term_counts(data, bounds, group[first:stop])
                    yield rows(terms, term, langs.take(pa.array(g)), sources.take(pa.array(g)), n, docs)

    return count


def shares(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / of), exactly, for `of` under 9 * 10^15: three decimal places at a time, so that nothing overflows."""
    out, left = np.zeros(np.broadcast_shapes(np.shape(count), np.shape(of)), np.int64), np.asarray(count) + 1
    for _ in range(3):
        whole, left = np.divmod(left * 1000, of)
        out = out * 1000 + whole
    return out + 1


def _share(count: Column, of: Column) -> Column:
    """The same as shares(), in SQL."""
    out, left = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        ahead = left * 1000
        left = F.pmod(ahead, of)
        out = out * 1000 + F.call_function("div", ahead - left, of)
    return out + 1


def _pairs(params: Params):
    def pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, i, j, bucket = (k.as_py() for k in key)
        names = table.filter(pa.compute.is_null(table["term"]))
        place, of = names["place"].to_numpy(), names["of"].to_numpy()
        first, second = (np.flatnonzero(place // params.block == b) for b in (i, j))
        sums = np.zeros((len(first), len(second)), np.int64)
        all_terms = int(names["kept_terms"][0].as_py())
        if all_terms:
            zero = [shares(np.zeros(len(x), np.int64), of[x]) for x in (first, second)]
            neither = (zero[0][:, None] - zero[1]) ** 2 // zero[1]  # the value of a term that neither source has
            if bucket == 0:
                sums += all_terms * neither
            counts = table.filter(pa.compute.is_valid(table["term"]))
            column = counts["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            row, n = counts["place"].to_numpy(), counts["n"].to_numpy()
            order = np.argsort(column, kind="stable")
            column, row, n = column[order], row[order], n[order]
            where = [np.full(place.max() + 1, -1), np.full(place.max() + 1, -1)]
            for w, x in zip(where, (first, second)):
                w[place[x]] = np.arange(len(x))
            width = int(column[-1]) + 1 if len(column) else 0
            for at in range(0, width, STRETCH):
                size = min(STRETCH, width - at)
                a, b = np.searchsorted(column, [at, at + size])
                dense = []
                for w, x, z in zip(where, (first, second), zero):
                    p = np.repeat(z[:, None], size, axis=1)
                    r = w[row[a:b]]
                    mine = r >= 0
                    p[r[mine], column[a:b][mine] - at] = shares(n[a:b][mine], of[x][r[mine]])
                    dense.append(p)
                lines = np.arange(len(second)) * size
                for k, p in enumerate(dense[0]):
                    value = (p - dense[1]) ** 2 // dense[1]
                    sums[k] += np.add.reduceat(value.ravel(), lines) - size * neither[k]
        a, b = np.divmod(np.arange(sums.size), max(1, len(second)))
        other = place[first][a] != place[second][b]
        label = names["source"].combine_chunks()
        return pa.table({"lang": pa.array([lang] * int(other.sum()), pa.binary()), "source": label.take(pa.array(first[a[other]])), "item": label.take(pa.array(second[b[other]])), "value": sums.ravel()[other]})

    return pairs


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", params: Params = Params()) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by divergence, part `term` the terms that the source uses more than its language does.

    Null text, lang or source is empty, and an empty lang or source is one like any other. A group without terms has every pair,
    with no count anywhere; a language that keeps no term gives pairs of value 0. Each row is a document of its own, whatever
    its id. Ties go by the bytes of the item. Further columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    texts = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary") for c in (lang_col, source_col, text_col))).toDF("lang", "source", "text")
    counts = texts.mapInArrow(_counts(params), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    named = F.length("term") == 0
    kept = staged(
        counts.withColumns({"in_docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "nth": F.row_number().over(of_term.orderBy("source"))})
        .where(named | (F.col("in_docs") >= params.least_docs))
        .select("lang", "source", "term", "n", "total", "nth")
    )
    whole = Window.partitionBy("lang")
    size = F.sum("own_n").over(whole)
    groups = (
        kept.groupBy("lang", "source")
        .agg(F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("own_n"), F.count_if(~named).alias("entries"), F.count_if(~named & (F.col("nth") == 1)).alias("heads"))
        .withColumn("kept_terms", F.sum("heads").over(whole))
        .select(
            F.struct("lang", "source").alias("group"), "entries", "kept_terms", (F.col("own_n") + F.col("kept_terms")).alias("of"), (size + F.col("kept_terms")).alias("lang_of"),
            (F.row_number().over(whole.orderBy("source")) - 1).cast("long").alias("place"),
            F.ceil(F.count(F.lit(1)).over(whole) / params.block).cast("long").alias("blocks"), F.sum("entries").over(whole).alias("lang_entries"),
        )
    )
    groups = staged(groups)
    n_groups, n_entries = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    entries = kept.where(~named).select(F.struct("lang", "source").alias("group"), "term", "n", "total")
    if n_groups <= params.most_broadcast:
        entries = entries.join(F.broadcast(groups), "group")
    else:
        entries = dealt_join(entries, groups, "group", hot_keys(groups.select("group", "entries"), n_entries), "term")

    p, q = _share(F.col("n"), F.col("of")), _share(F.col("total"), F.col("lang_of"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = entries.select("group.lang", "group.source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    stand_out = more.select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= params.top)

    own = F.floor(F.col("place") / params.block)
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cells = F.array_distinct(F.concat(F.transform(every, lambda x: F.struct(own.alias("i"), x.alias("j"))), F.transform(every, lambda x: F.struct(x.alias("i"), own.alias("j")))))
    buckets = 1 + F.floor(F.col("lang_entries") * 2 / F.col("blocks") / params.rows)
    columns = ["lang", "i", "j", "bucket", "place", "source", "of", "kept_terms", "term", "n"]
    spread = lambda df: df.withColumn("cell", F.explode(cells)).select("*", "group.*", "cell.*").select(*columns)
    counted = spread(entries.withColumn("bucket", F.pmod(F.xxhash64("term"), buckets)))
    headed = spread(groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1))).withColumns({"term": F.lit(None).cast("binary"), "n": F.lit(0).cast("long")}))
    summed = headed.unionByName(counted).groupBy("lang", "i", "j", "bucket").applyInArrow(_pairs(params), _PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(stand_out).select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "part", F.col("item").cast("string").alias("item"), "value", "rank")
