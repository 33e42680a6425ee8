"""Removal of word windows that occur earlier in the corpus, found through fixed blocks as anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roiscore.llm import words
from roiscore.llm.common import give_back, id_and_text, text_slices, with_carried

#: Windows that a task gathers before it sends them on, and that one range of hashes should get in all.
FLUSH_WINDOWS = 250_000
RANGE_WINDOWS = 500_000
#: What it gathers at most, where there are very many ranges.
MOST_FLUSHED = 2_000_000
_NULL_ID = (1 << 63) - 1


class _Words:
    """Word hashes of consecutive documents, and which runs of n words lie in one document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.first = words.spans(data, bounds)
        self.hash = words.hashes(data, self.starts, self.ends)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.owner)) - self.first[:-1][self.owner]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        run = words.runs(self.hash, n)
        return run, self.owner[: len(run)] == self.owner[n - 1 :] if len(run) else np.empty(0, bool)


def _range(values: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit hash, by its top bits; ranges is a power of two."""
    return (values >> np.uint64(65 - ranges.bit_length())).astype(np.int32) if ranges > 1 else np.zeros(len(values), np.int32)


def _flush(ranges: int) -> int:
    """Windows that a task gathers: more where there are so many ranges that each would get next to none of them."""
    return max(FLUSH_WINDOWS, min(8 * ranges, MOST_FLUSHED))


def _below(values: np.ndarray, ranges: int) -> np.ndarray:
    """The 32 bits below those that name the range."""
    return (values >> np.uint64(33 - ranges.bit_length())).astype(np.uint32)


def _rows(ranges: np.ndarray, **columns: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """A row for each range, with its part of every column (values, bounds) as bytes; nothing is copied."""
    packed = [pa.Array.from_buffers(pa.binary(), len(ranges), [None, pa.py_buffer((bounds * v.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(v))]) for v, bounds in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(ranges), *packed], names=["range", *columns])


def _bounds(ranges: np.ndarray, occupied: np.ndarray) -> np.ndarray:
    """Where each occupied range begins in sorted ranges, and the end."""
    return np.append(np.searchsorted(ranges, occupied), len(ranges))


def _dealt(n: int, rows: int) -> np.ndarray:
    """Bounds that deal n values evenly over the rows."""
    return np.arange(rows + 1) * n // rows


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid)])


def _anchors(docs: DataFrame, block: int, ranges: int) -> DataFrame:
    """Hashes of all rolling runs of `block` words and of the blocks that start at multiples of `block`, by range; docs has row and text.

    Each task sends a run's hash once; a block whose run it has met twice is a hit already and is sent on as such.
    """

    def send(grams: list, blocks: list, keys: list, places: list) -> pa.RecordBatch:
        gram, count = np.unique(np.concatenate(grams), return_counts=True)
        b, key, place = (np.concatenate(x) for x in (blocks, keys, places))
        order = np.argsort(b)
        b, key, place = b[order], key[order], place[order]
        sure = count[np.searchsorted(gram, b)] > 1
        sure_key, sure_place = key[sure], place[sure]
        b, key, place = b[~sure], key[~sure], place[~sure]
        of = _range(gram, ranges)
        held = np.unique(of)  # a block is a run, too, so it lies in one of these
        at, to, even = _bounds(of, held), _bounds(_range(b, ranges), held), _dealt(len(sure_key), len(held))
        return _rows(held, grams=(_below(gram, ranges), at), blocks=(_below(b, ranges), to), docs=(key, to), places=(place, to), sure_docs=(sure_key, even), sure_places=(sure_place, even))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for batch in batches:
            names = batch.column(0).to_numpy()
            for first, stop, data, bounds in text_slices(batch.column(1)):
                w = _Words(data, bounds)
                run, inside = w.runs(block)
                head = np.flatnonzero(inside & (w.place[: len(run)] % block == 0))
                for part, x in zip(found, (run[inside], run[head], names[first:stop][w.owner[head]], (w.place[head] // block).astype(np.int32))):
                    part.append(x)
                n += int(inside.sum())
                if n >= _flush(ranges):
                    yield send(*found)
                    found, n = ([], [], [], []), 0
                    give_back()
        if n:
            yield send(*found)

    return docs.mapInArrow(scan, "range int, grams binary, blocks binary, docs binary, places binary, sure_docs binary, sure_places binary")


def _hit_blocks(table: pa.Table) -> pa.Table:
    """Blocks of one range whose run of words occurs elsewhere, too."""
    gram, count = np.unique(_joined(table["grams"], np.uint32), return_counts=True)
    hit = np.isin(_joined(table["blocks"], np.uint32), gram[count > 1])
    row = np.concatenate([_joined(table["docs"], np.int64)[hit], _joined(table["sure_docs"], np.int64)])
    place = np.concatenate([_joined(table["places"], np.int32)[hit], _joined(table["sure_places"], np.int32)])
    return pa.table({"row": row, "block": place})


def _stretches(row: np.ndarray, start: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of stretches of windows that follow one another in a document (and are equal in `more`)."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(row))


def _earliest(value: np.ndarray, least: np.ndarray, key: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, late): windows by their two hashes, id, row and start; whether each is the first of equal ones there, and whether another starts earlier."""
    order = np.lexsort((start, row, key, least, value))
    first = np.ones(len(order), bool)
    first[1:] = (value[order][1:] != value[order][:-1]) | (least[order][1:] != least[order][:-1])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    return order, first, (row[order] != row[head]) | (start[order] != start[head])


def _candidates(hits: DataFrame, block: int, window: int, ranges: int) -> DataFrame:
    """Windows around hit blocks, by range of a hash of their smallest run of `block` words, so that neighbours stay together.

    Equal windows have equal smallest runs; these are small numbers, which the hash spreads over the ranges. Each task sends the first of equal windows; the others repeat it for sure.
    """

    def send(parts: list) -> pa.RecordBatch:
        value, key, row, start, least = (np.concatenate(x) for x in zip(*parts))
        order, foremost, late = _earliest(value, least, key, row, start)
        sure, kept = np.sort(order[late]), np.sort(order[foremost])
        s_first, s_len = _stretches(row[sure], start[sure])
        s_row, s_start, s_len = row[sure][s_first], start[sure][s_first], s_len.astype(np.int32)
        first, length = _stretches(row[kept], start[kept], least[kept])
        by = np.argsort(least[kept][first], kind="stable")
        first, length = first[by], length[by]
        pos = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(len(kept))
        of = _range(least[kept][first], ranges)
        held = np.unique(of)
        at, even = _bounds(of, held), _dealt(len(s_row), len(held))
        window_at = np.append(0, np.cumsum(length))[at]
        return _rows(held, hashes=(value[kept][pos], window_at), leasts=(least[kept][first], at), keys=(key[kept][first], at), docs=(row[kept][first], at), starts=(start[kept][first], at), lengths=(length.astype(np.int32), at), sure_docs=(s_row, even), sure_starts=(s_start, even), sure_lengths=(s_len, even))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            keys, names, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for first, stop, data, bounds in text_slices(batch.column(2)):
                w = _Words(data, bounds)
                value, inside = w.runs(window)
                hit = blocks.slice(first, stop - first)
                place = hit.flatten().to_numpy().astype(np.int64) * block
                at = w.first[:-1][np.repeat(np.arange(stop - first), [len(x) for x in hit])] + place
                near = np.zeros(len(w.hash) + 1, np.int64)  # +1 and -1 where windows that hold a hit block begin and end
                reach = window - block
                np.add.at(near, np.maximum(at - reach, 0), 1)
                np.add.at(near, np.minimum(at + 1, len(near) - 1), -1)
                chosen = np.flatnonzero(inside & (np.cumsum(near)[: len(value)] > 0))
                run, size = words.runs(w.hash, block), 1
                while size * 2 <= reach + 1:
                    run, size = np.minimum(run[:-size], run[size:]), size * 2
                run = np.minimum(run[: len(run) - (reach + 1 - size)], run[reach + 1 - size :])
                own = first + w.owner[chosen]
                parts.append((value[chosen], keys[own], names[own], w.place[chosen].astype(np.int32), words.mix(run[chosen])))
                n += len(chosen)
                if n >= _flush(ranges):
                    yield send(parts)
                    parts, n = [], 0
                    give_back()
        if n:
            yield send(parts)

    return hits.mapInArrow(scan, "range int, hashes binary, leasts binary, keys binary, docs binary, starts binary, lengths binary, sure_docs binary, sure_starts binary, sure_lengths binary")


def _repeated(table: pa.Table) -> pa.Table:
    """Stretches of windows of one range that start earlier elsewhere."""
    length = _joined(table["lengths"], np.int32).astype(np.int64)
    key, row = (np.repeat(_joined(table[c], np.int64), length) for c in ("keys", "docs"))
    start = np.repeat(_joined(table["starts"], np.int32) - (np.cumsum(length) - length), length) + np.arange(length.sum())
    order, _, late = _earliest(_joined(table["hashes"], np.uint64), np.repeat(_joined(table["leasts"], np.uint64), length), key, row, start)
    row, start = row[order][late], start[order][late]
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first, length = _stretches(row, start)
    return pa.table({"row": np.concatenate([row[first], _joined(table["sure_docs"], np.int64)]), "start": np.concatenate([start[first].astype(np.int32), _joined(table["sure_starts"], np.int32)]), "length": np.concatenate([length.astype(np.int32), _joined(table["sure_lengths"], np.int32)])})


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word covered by a window of words that starts earlier, too, is removed.

    A window is `window` consecutive words of one document; earlier means a smaller id, or the same id and an earlier
    start. `kept` has the words left, joined by a space. Windows are judged on the input.

    1. Blocks of window / 2 words at multiples of that length are the reference; every rolling run of that length probes
       them. Any window holds a whole block, so a repeated window holds a block that another run equals.
    2. Hit blocks are extended: all windows that hold one are compared by their hashes, stretch by stretch, and all but
       the first of equal ones become stretches to remove.

    Hashes travel in packed arrays, one for each flush of a task and range that it holds. Within a task equal ones are sent once, so neither a
    passage nor a block of any frequency fills a range; the number of ranges follows the size of the text. Blocks are
    found by about 40 bits of hash, which only adds candidates; windows are compared by 128: their own hash, and that of their
    smallest run, which is sent once for a stretch.

    Null or empty texts have no words and keep an empty text. Rows that share an id are documents that follow one another in
    the order of a hash of their texts (null ids come last); rows equal in id and text are one document and
    keep or lose the same words. Rows are told apart by 64 bits of hash of both. An empty table gives no rows; extra columns are not read, but
    those in `carry` go along as the struct column `carried`, and the text as it was as `text`.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    block = window // 2
    docs = id_and_text(docs, id_col, text_col, carry).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID))).withColumnRenamed("doc_id", "key").withColumn("row", F.xxhash64("key", "text"))
    carried = [c for c in docs.columns if c == "carried"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, int(np.ceil(np.log2(max(1, size / 6 / RANGE_WINDOWS)))))
    schema = "row long, block int"
    blocks = _anchors(docs.select("row", "text"), block, ranges).groupBy("range").applyInArrow(_hit_blocks, schema).groupBy("row").agg(F.collect_set("block").alias("blocks"))
    # the carried column is read here only to have the texts dealt out once: both joins use one exchange
    found = _candidates(docs.join(blocks, "row").select("key", "row", "text", "blocks", *carried), block, window, ranges)
    stretches = found.groupBy("range").applyInArrow(_repeated, "row long, start int, length int")
    removed = stretches.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            begin, length, given = batch.column(2), batch.column(3), {k: batch.column(k) for k in ("text", "carried") if "carried" in batch.schema.names}
            for first, stop, data, bounds in text_slices(batch.column(1)):
                raw = data.tobytes()
                for i, a, b in zip(range(first, stop), bounds[:-1].tolist(), bounds[1:].tolist()):
                    found = raw[a:b].split()
                    n_words.append(len(found))
                    gone = np.zeros(len(found) + 1, np.int64)
                    if begin[i].is_valid:
                        s = begin[i].values.to_numpy().astype(np.int64)
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + length[i].values.to_numpy() + window - 1, -1)
                    left = np.cumsum(gone[:-1]) == 0
                    n_removed.append(len(found) - int(left.sum()))
                    kept.append(b" ".join(found if not n_removed[-1] else [w for w, x in zip(found, left.tolist()) if x]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *given.values()], names=["key", "n_words", "n_removed", "kept", *given])

    left = docs.join(removed, "row", "left").select("key", "text", "starts", "lengths", *carried).mapInArrow(remove, with_carried("key long, n_words long, n_removed long, kept string" + ", text string" * (carry is not None), docs))
    return left.withColumn("key", F.nullif("key", F.lit(_NULL_ID))).withColumnRenamed("key", "doc_id")
