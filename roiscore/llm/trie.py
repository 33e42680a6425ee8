"""Prefix trie of conversations: every distinct opening is a node, and totals of subtrees come by peeling leaves.

A node is known by a 120-bit hash of its turns, an exclusive or of one hash for each turn and place, so that running values of a
long conversation can be made in blocks. Of each node the conversation with the smallest id stands for it; the nodes that one
conversation stands for are a stretch of its own path, a chain, and chains are what is peeled: a chain holds a counter of the
chains that hang on it, and when all have finished it sends its totals to the node that it hangs on, until only that of the
root is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roiscore.llm.common import cut_counted, dealt_join, hot_keys, small_batches, staged
from roiscore.session import ship

#: Turns of a conversation, or nodes of a chain, whose running values are made in one task.
BLOCK = 4096
#: Ids in one row of those that are hashed in order.
RUN = 4096
#: Chains on one node beyond which they are dealt out over several tasks, or a thousandth of all if that is more.
HOT_CHAINS = 256
#: Bits of a position in a partition, as monotonically_increasing_id has them.
_PLACE = 33
_NODE = ["depth", "k1", "k2"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _halves(text: Column, one: str, two: str) -> dict[str, Column]:
    """Two numbers of 60 bits from the MD5 of a text."""
    digest = F.md5(text)
    return {one: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), two: F.conv(F.substring(digest, 17, 15), 16, 10).cast("long")}


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv_id, part, place, d1, d2, words), (conv_id, part, first, before, n)): the turns of each conversation in order; that at `place` of `part` is number place - first + before.

    They are dealt out by ranges of the order itself, so that a conversation of any length, or any number of equal rows, is
    shared by tasks.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = staged(
        turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
        .where("conv_id is not null")
        .withColumns(_halves(F.concat(F.char_length("role"), F.lit(":"), "role", "text"), "d1", "d2"))
        .select("conv_id", "turn", "d1", "d2", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("salt"))
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("d1"), F.col("d2"), F.col("salt")]
    number = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", number)
    rows = staged(rows.select("conv_id", F.shiftright("number", _PLACE).alias("part"), F.col("number").bitwiseAND((1 << _PLACE) - 1).alias("place"), "d1", "d2", "words"))
    parts = rows.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def shared_openings(turns: DataFrame, every: int = 20, most: int = 4, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which conversation c begins with the first h turns of c - c % every, and goes on with its own from h on; h is crc32 of its decimal id, modulo `most`."""
    rows, parts = ordered_turns(turns, **columns)
    parts = staged(parts)
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    bases = parts.where(F.col("conv_id") % every == 0).groupBy(F.col("conv_id").alias("base")).agg(F.sum("n").alias("base_n"))
    opening = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = staged(convs.join(bases, "base", "left").select("conv_id", "base", "h", opening.alias("opening"), (opening + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    placed = parts.join(convs, "conv_id").select("conv_id", "part", (F.col("before") - F.col("first")).alias("shift"), "h", "opening", "length")
    placed = staged(rows.join(placed, ["conv_id", "part"]).withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift"))
    columns = ["conv_id", "at", "length", "d1", "d2", "words"]
    own = placed.where("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("opening")).select(*columns)
    lent = placed.where((F.col("conv_id") % every == 0) & (F.col("at") < most - 1)).select(F.col("conv_id").alias("base"), "at", "d1", "d2", "words")
    lent = lent.join(convs.select("conv_id", "base", "opening", "length"), "base").where("at < opening").select(*columns)
    return own.unionByName(lent), convs.select("conv_id", "length")


def plain_turns(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as they are."""
    rows, parts = ordered_turns(turns, **columns)
    parts = staged(parts.withColumn("length", F.sum("n").over(Window.partitionBy("conv_id"))))
    rows = rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") - F.col("first") + F.col("before")).alias("at"), "length", "d1", "d2", "words")
    return rows, parts.groupBy("conv_id").agg(F.max("length").alias("length"))


def _running(df: DataFrame, at: str, columns: list[str], total, join, down: bool = False) -> DataFrame:
    """df, with each column's running total over the rows of its conv_id in the order of `at`, downwards if asked for; made in blocks, which are then joined by their own totals."""
    df = df.withColumn("_block", F.floor(F.col(at) / BLOCK))
    turned = F.desc if down else F.asc
    inside = Window.partitionBy("conv_id", "_block").orderBy(turned(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("conv_id").orderBy(turned("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("conv_id", "_block").agg(*(total(c).alias(c) for c in columns))
    blocks = blocks.select("conv_id", "_block", *(total(c).over(ahead).alias(f"_{c}") for c in columns)).where(F.col(f"_{columns[0]}").isNotNull())  # none for most
    df = df.withColumns({c: total(c).over(inside) for c in columns}).join(blocks, ["conv_id", "_block"], "left")
    return df.withColumns({c: join(F.col(c), F.coalesce(f"_{c}", F.lit(0))) for c in columns}).drop("_block", *(f"_{c}" for c in columns))


def _id_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted (node, id) as rows of (node, first id, ids joined by commas), of RUN ids at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.stack([batch.column(k).to_numpy() for k in range(3)])
        ids = batch.column(3).to_pylist()
        new = np.flatnonzero((node[:, 1:] != node[:, :-1]).any(axis=0)) + 1
        bounds = np.unique(np.concatenate([new, np.arange(0, len(ids), RUN), [len(ids)]])).tolist()
        at = pa.array(bounds[:-1])
        joined = pa.array([",".join(map(str, ids[a:b])) for a, b in zip(bounds, bounds[1:])], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), joined], names=[*_NODE, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, SHA-256 of all its ids) from sorted runs; no more than a run is held."""
    node, digest = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if key == node:
                digest.update(b",")
            else:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield _hash_rows(done)
    yield _hash_rows([(*node, digest.hexdigest())] if node else [])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)], names=[*_NODE, "ends_sha256"])


def _peeled(chains: DataFrame) -> DataFrame:
    """(parent, attach, saved, leaves) of every chain but the root's: totals of its whole subtree.

    chains: (conv_id, parent, attach, waiting, saved, leaves), with its own totals and the number of chains that hang on it. A round
    ends all chains whose counter is 0; there are as many rounds as chains lie over one another, whatever their length.
    """
    finished = []
    left, n = cut_counted(chains)
    while n > 1:
        ready = left.where("waiting = 0")
        finished.append(ready)
        sent = ready.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
        add = lambda c, sign=1: F.col(c) + sign * F.coalesce(f"_{c}", F.lit(0))
        left = left.where("waiting > 0").join(sent, "conv_id", "left").select("conv_id", "parent", "attach", (F.col("waiting") - F.coalesce("_n", F.lit(0))).alias("waiting"), add("saved").alias("saved"), add("leaves").alias("leaves"))
        left, n = cut_counted(left)
    done = reduce(DataFrame.unionByName, finished) if finished else left
    return done.where("parent is not null").select("parent", "attach", "saved", "leaves")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct opening of the conversations, from the root of depth 0 on: conv_id (the smallest that begins so), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: (conv_id, at, length, d1, d2, words), convs: (conv_id, length), as `plain_turns` and `shared_openings` give them. Turns of
    one number are put in the order of their digests; equal rows are turns one after another. Null roles and texts are empty;
    rows without a conversation id are in none. Conversations without turns are members of the root alone. An empty
    table gives no rows, not even a root.
    """
    spark = turns.sparkSession
    ship(spark)
    small_batches(spark)
    turns = turns.withColumns(_halves(F.concat_ws(",", "d1", "d2", "at"), "x1", "x2"))
    turns = staged(turns.select("conv_id", "at", (F.col("at") + 1 == F.col("length")).alias("last"), "words", "x1", "x2", F.col("x1").alias("k1"), F.col("x2").alias("k2")))
    paths = staged(_running(turns, "at", ["k1", "k2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b)))
    above = lambda k: F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}"))
    nodes = paths.groupBy((F.col("at") + 1).alias("depth"), "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min(above(1)).alias("up1"), F.min(above(2)).alias("up2")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(*(zero.alias(c) for c in _NODE), "conv_id", "n_convs", *(zero.alias(c) for c in ("words", "up1", "up2")))
    nodes = staged(nodes.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("words")))

    chains = staged(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("own"), F.min_by("up1", "depth").alias("up1"), F.min_by("up2", "depth").alias("up2")))
    hanging = chains.where("top > 0").select("conv_id", "top", F.struct(F.col("top") - 1, "up1", "up2").cast("struct<depth:bigint,k1:bigint,k2:bigint>").alias("on"))
    hot = hot_keys(hanging.groupBy("on").count(), chains.count(), HOT_CHAINS)
    places = nodes.select(F.struct(*_NODE).alias("on"), F.col("conv_id").alias("parent"))
    hanging = staged(dealt_join(hanging, places, "on", hot, "conv_id").select("conv_id", "parent", (F.col("top") - 1).alias("attach")))
    kids = hanging.groupBy("parent", "attach").agg(F.count(F.lit(1)).alias("kids"))
    ends_in_kids = kids.select(F.col("parent").alias("conv_id"), F.col("attach").alias("bottom"), F.lit(0).cast("long").alias("leaf"))
    waiting = kids.groupBy(F.col("parent").alias("conv_id")).agg(F.sum("kids").alias("waiting"))
    held = chains.select("conv_id", "bottom", "own").join(hanging, "conv_id", "left").join(waiting, "conv_id", "left").join(ends_in_kids, ["conv_id", "bottom"], "left")
    totals = _peeled(held.select("conv_id", "parent", "attach", F.coalesce("waiting", zero).alias("waiting"), F.col("own").alias("saved"), F.coalesce("leaf", F.lit(1).cast("long")).alias("leaves")))

    # what is known of single nodes: where a chain begins and ends, and what hangs there
    none = F.lit(None).cast("long")
    facts = reduce(
        DataFrame.unionByName,
        [
            chains.select("conv_id", F.col("bottom").alias("depth"), none.alias("parent"), F.lit(1).alias("bottom"), *(zero.alias(c) for c in ("kids", "saved", "leaves"))),
            hanging.select("conv_id", (F.col("attach") + 1).alias("depth"), "parent", F.lit(0).alias("bottom"), *(zero.alias(c) for c in ("kids", "saved", "leaves"))),
            totals.groupBy(F.col("parent").alias("conv_id"), F.col("attach").alias("depth")).agg(F.count(F.lit(1)).alias("kids"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).withColumns({"parent": none, "bottom": F.lit(0)}),
        ],
    )
    facts = facts.groupBy("conv_id", "depth").agg(F.max("parent").alias("parent"), F.max("bottom").alias("bottom"), *(F.sum(c).alias(c) for c in ("kids", "saved", "leaves")))
    known = lambda c: F.coalesce(c, F.lit(0))
    nodes = nodes.join(facts, ["conv_id", "depth"], "left").select(
        "conv_id", *_NODE, "n_convs",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        (known("kids") + 1 - known("bottom")).alias("n_children"),
        (F.col("own") + known("saved")).alias("saved_tokens"),
        (known("leaves") + F.when((known("bottom") == 1) & (known("kids") == 0), 1).otherwise(0)).alias("n_leaves"),
    )
    nodes = _running(staged(nodes), "depth", ["saved_tokens", "n_leaves"], F.sum, lambda a, b: a + b, down=True)

    ends = paths.where("last").select((F.col("at") + 1).alias("depth"), "k1", "k2", "conv_id").unionByName(convs.where("length = 0").select(*(zero.alias(c) for c in _NODE), "conv_id"))
    runs = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_id_runs, "depth long, k1 long, k2 long, first long, ids string")
    hashes = runs.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")
    nodes = nodes.join(hashes, _NODE, "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
