"""Approximate nearest neighbours by inner product, by counting collisions in query-centred windows of sorted projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roiscore.llm.common import small_batches
from roiscore.session import ship


@dataclass(frozen=True)
class Params:
    """projections: sorted arrays of a block. threshold: share of them in which a vector must fall into the query's window
    to be verified. share: of a block's vectors that must reach it before the windows stop widening (and k more).
    start, step: half of the first windows, in interquartile ranges of the projections, and by which a round widens them. block, queries: vectors and queries
    that meet in one task; the vectors are held, the queries stream past them."""

    projections: int = 128
    threshold: float = 0.7
    share: float = 0.16
    start: float = 0.75
    step: float = 1.12
    block: int = 8192
    queries: int = 65536
    seed: int = 7


class SortedProjections:
    """Projections of a block's vectors on random directions, each sorted.

    Vectors get one more coordinate, sqrt(longest**2 - length**2), and queries 0, so that the nearest by distance is the
    one with the largest inner product.
    """

    def __init__(self, vectors: np.ndarray, longest: float, p: Params):
        self.p, self.vectors = p, vectors
        rng = np.random.default_rng(p.seed)
        self.directions = rng.normal(size=(vectors.shape[1], p.projections))
        last = rng.normal(size=p.projections)
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        values = (vectors @ self.directions + rest[:, None] * last).T
        order = np.argsort(values, axis=1)
        self.values = np.take_along_axis(values, order, 1)
        n = len(vectors)
        # where each vector stands in each sorted array: it collides where that lies in the window
        self.place = np.empty(values.shape, np.int16 if n < 1 << 15 else np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=self.place.dtype)[None], 1)
        middle = np.median(self.values[:, 3 * n // 4] - self.values[:, n // 4]) * p.start
        self.width = float(middle) or float(np.abs(values).max()) or 1.0

    def candidates(self, queries: np.ndarray, k: int):
        """(query's place, places of vectors) as soon as enough vectors have collided with the query; all of them where k is no fewer.

        A round widens every window around its query (virtual rehashing) and counts in how many of them each vector lies.
        """
        n, p = len(self.vectors), self.p
        need, want = int(np.ceil(p.threshold * p.projections)), k + int(p.share * n)
        if want >= n:
            for q in range(len(queries)):
                yield q, np.arange(n)
            return
        at = queries @ self.directions
        active, width = np.arange(len(queries)), self.width
        kind = self.place.dtype
        wide = np.dtype(f"u{kind.itemsize}")
        off, inside = np.empty_like(self.place), np.empty(self.place.shape, bool)
        while len(active):
            low, high = (np.stack([np.searchsorted(v, at[active, j] + sign * width, side) for j, v in enumerate(self.values)], 1) for sign, side in ((-1, "left"), (1, "right")))
            size = (high - low).astype(wide)[:, :, None]
            low = low.astype(kind)[:, :, None]
            left = []
            for i, q in enumerate(active.tolist()):
                np.subtract(self.place, low[i], out=off)
                np.less(off.view(wide), size[i], out=inside)  # places before the window are large without a sign
                found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if p.projections < 256 else np.int32) >= need)
                if len(found) >= want:
                    yield q, found
                else:
                    left.append(i)
            active, width = active[left], width * p.step


def _usable(vector: Column) -> Column:
    """Vectors with components, all of them finite, and not all 0."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (a condition on the column vec_id) chooses, the k nearest
    found among all other rows, by inner product in double precision, ties to the smaller id.

    Rows are dealt out by hash into blocks, and each block meets each group of queries in one task. The task holds the block alone: it builds the
    sorted projections once, and the group's queries stream past them, a batch at a time; for each, windows are widened, what has collided
    often enough is verified, and k rows are sent. So work is queries times rows over the projections, and no row is left out.
    Rows are copied once for every group of queries, and queries once for every block: both are large, so that copies are few, and
    groups are bounded, so that a lost task is soon done again.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids and vectors
    of another length than most. Rows with the query's id are its own; of rows that share an id the one with the smallest
    vector asks, and all are found. They are dealt out by id and vector, so an id of many rows does not fill a block. Fewer than k other rows give fewer
    results; an empty table gives none; extra columns are not read.
    """
    ship(vectors.sparkSession)
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.count_if(queries).alias("asked")).orderBy(F.desc("n"), "dim").first()
    dim, n, longest, asked = sizes or (1, 0, 0.0, 0)
    rows = rows.where(F.size("vector") == dim)
    blocks, groups = max(1, -(-n // params.block)), max(1, -(-asked // params.queries))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int, asks: bool) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")
        return df.select(number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other), F.lit(asks).alias("asks"), "vec_id", "vector").select("block", "group", "asks", "vec_id", "vector")

    data = dealt(rows, "block", blocks, "group", groups, False)
    asking = dealt(rows.where(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "group", groups, "block", blocks, True)

    def answers(index: SortedProjections, ids: np.ndarray, own: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        x = index.vectors
        for first in range(0, len(q), 64):
            for i, found in index.candidates(q[first : first + 64], k + 1):
                found = found[ids[found] != own[first + i]]
                if len(found) > k:  # what can't be among the best by more than rounding goes before scores are added up in one order
                    near = x[found] @ q[first + i]
                    found = found[near >= np.partition(near, -k)[-k] - 1e-9 * longest**2]
                score = (x[found] * q[first + i]).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k]
                for column, v in zip(out, (np.full(len(best), own[first + i]), ids[found][best], score[best])):
                    column.append(v)
        kinds = (np.int64, np.int64, np.float64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, t), *v])) for t, v in zip(kinds, out)], names=["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: of every block and group first the vectors, then the queries."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, index, ids = None, None, None
        for batch in batches:
            block, group = (batch.column(c).to_numpy() for c in (0, 1))
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            vec_id, vector = batch.column(3).to_numpy(), _matrix(batch.column(4), dim)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(group) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if a == b:
                    continue
                if now != (block[a], group[a]):
                    now, held, index = (block[a], group[a]), [], None
                if not asks[a]:
                    held.append((vec_id[a:b], vector[a:b]))
                elif held or index:
                    if index is None:
                        ids, x = (np.concatenate(v) for v in zip(*held))
                        order = np.argsort(ids, kind="stable")
                        ids, index, held = ids[order], SortedProjections(x[order], longest, params), []
                    yield answers(index, ids, vec_id[a:b], vector[a:b])

    met = data.unionByName(asking).repartition("block", "group").sortWithinPartitions("block", "group", "asks")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
