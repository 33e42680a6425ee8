"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiscore.llm.common import cut, cut_counted, dealt_join, hot_keys

#: Edges (16 bytes each) that one task takes at a time: rounds go on while more are left.
TASK_EDGES = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to): the smallest node that the edges of one task lead to."""
    u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), (np.empty(0, np.int64),) * 2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "to"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (a, b), the smallest node that it can reach.

    Rounds of contraction: every node moves to the node among itself and its neighbours that comes first in an order
    drawn anew in each round (by the number with some of its bits turned), and edges whose ends have met are dropped. Nodes shrink by a
    constant factor a round, whatever the graph's shape, and only edges that are left are written. Once no more than
    TASK_EDGES are left, one task follows these. The moves are then followed from round to round.

    Minima are partial aggregates, and joins deal the edges of a hub out, so its neighbours never meet in one task. Null ends, loops and repeated edges are ignored; a table without edges gives no rows.
    """
    now, left = cut_counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    moves = []
    while left > TASK_EDGES:
        turn = F.lit(Random(len(moves)).getrandbits(63))
        both = now.unionAll(now.select("v", "u"))
        move = both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(turn)).alias("m")).select(F.col("u").alias("node"), F.least("m", F.col("u").bitwiseXOR(turn)).bitwiseXOR(turn).alias("to"))
        moves.append(move)
        for end, other in ("uv", "vu"):
            hubs = hot_keys(now.groupBy(end).count(), left)
            now = dealt_join(now.withColumnRenamed(end, "node"), move, "node", hubs, other).select(F.col("to").alias(end), other)
        now, left = cut_counted(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found = now.coalesce(1).mapInArrow(_joined, "node long, to long")
    if not moves:
        return found.withColumnRenamed("to", "root")
    last = found
    found = moves[0].withColumnRenamed("to", "end")
    for move in [*moves[1:], last]:
        found = found.join(move.withColumnRenamed("node", "end"), "end", "left").select("node", F.coalesce("to", "end").alias("end"))
    found = cut(found)
    roots = cut(found.groupBy("end").agg(F.min("node").alias("root"), F.count("*").alias("n")))
    large = hot_keys(roots.select("end", "n"), roots.agg(F.sum("n")).first()[0] or 0)
    return dealt_join(found, roots.select("end", "root"), "end", large, "node").select("node", "root")
