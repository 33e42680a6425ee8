"""Self-join of documents on the Jaccard similarity of their word n-grams, by rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roiscore.llm import words
from roiscore.llm.common import HOT_ROWS, cut, cut_counted, dealt_join, hot_keys, id_and_text, staged, text_slices, with_carried
from roiscore.llm.components import connected
from roiscore.llm.sums import COLUMNS, added, parts

#: Size of the table of shingle counts by hash, one byte each once it is finished; the only table that every task gets. It grows with the text, up to 16 MB.
LEAST_BITS, MOST_BITS, BUCKET_BYTES = 20, 24, 1024
#: Parts of the hash range in a set's sketch, which holds the number of shingles in each (up to 255).
SKETCH = 128
#: Cuts of the suffix filter, one inside another.
SUFFIX_DEPTH = 4
#: Class ids that may be broadcast (8 bytes each); above it, the same join shuffles.
MOST_BROADCAST = 1_000_000


def _shingles(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, by document and hash."""
    data = words.lower(data)
    starts, ends, first = words.spans(data, bounds)
    word = words.hashes(data, starts, ends)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    run = words.runs(word, n)
    inside = owner[: len(run)] == owner[n - 1 :] if len(run) else np.empty(0, bool)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.array([words.runs(word[first[d] : first[d + 1]], int(count[d]))[0] ^ words.mix(count[d : d + 1].astype(np.uint64))[0] for d in short], np.uint64)
    owner, value = np.concatenate([owner[: len(run)][inside], short]), np.concatenate([run[inside], whole])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _signatures(owner: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, class id) of each document's set; equal sets have equal class ids, an empty set has 0."""
    size = np.bincount(owner, minlength=docs).astype(np.int64)
    total = np.zeros(docs, np.uint64)
    if len(value):
        total[size > 0] = np.add.reduceat(words.mix(value ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(size) - size)[size > 0])
    return size, np.where(size > 0, words.mix(total + size.astype(np.uint64)), 0).astype(np.uint64).view(np.int64)


def _sketches(owner: np.ndarray, value: np.ndarray, docs: int) -> list[bytes]:
    part = owner * SKETCH + (value & np.uint64(SKETCH - 1)).astype(np.int64)
    return [x.tobytes() for x in np.minimum(np.bincount(part, minlength=docs * SKETCH), 255).astype(np.uint8).reshape(docs, SKETCH)]


def _rare_first(owner: np.ndarray, value: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles in one order for all documents: the level of the count in the top byte, then 55 bits of the hash."""
    at = (value >> np.uint64(65 - len(level).bit_length())).astype(np.int64)
    out = (level[at].astype(np.uint64) << np.uint64(55)) | ((value & np.uint64((1 << 40) - 1)) << np.uint64(15)) | (value >> np.uint64(49))
    return out[np.lexsort((out, owner))].view(np.int64)


def _scan(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One pass: (doc_id, key, n, cls, sketch) of every document with its carried columns, and the task's counts of shingles by hash."""
    schema = with_carried(f"doc_id long, key long, n long, cls long, sketch binary, {COLUMNS}", docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        carried = None
        for batch in batches:
            carried = [batch.schema.field(c).type for c in batch.schema.names if c == "carried"]
            for first, stop, data, bounds in text_slices(batch.column("text")):
                owner, value = _shingles(data, bounds, n)
                np.add.at(counts, (value >> np.uint64(64 - bits)).astype(np.int64), 1)
                size, cls = _signatures(owner, value, stop - first)
                own = [batch.column(c).slice(first, stop - first) for c in ("doc_id", "key")]
                nothing = [pa.nulls(stop - first, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                more = [batch.column("carried").slice(first, stop - first)] if carried else []
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(cls), pa.array(_sketches(owner, value, stop - first), pa.binary()), *nothing, *more], names=schema.names)
        if carried is not None:
            part, places, sums = parts(counts)
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(part), pa.binary()), pa.array(part, pa.int32()), pa.array(places, pa.binary()), pa.array(sums, pa.binary()), *(pa.nulls(len(part), t) for t in carried)], names=schema.names)

    return docs.mapInArrow(scan, schema)


def _index(docs: DataFrame, n: int, percent: int, level, longest: int | None) -> DataFrame:
    """(v, salt, cls, info): the shingles in the prefix of every document's set, with the shingle's place (upper bits) and the set's size (31 bits) as info.

    Equal sets that one task meets are sent once. A shingle whose count may exceed `longest` is dealt out by class over salts from 1 on; others have the salt 0.
    """
    schema = pa.schema([("v", pa.int64()), ("salt", pa.int32()), ("cls", pa.int64()), ("info", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, met = np.frombuffer(level.value, np.uint8), set()
        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(0)):
                owner, value = _shingles(data, bounds, n)
                size, cls = _signatures(owner, value, stop - first)
                sent = np.zeros(len(cls), bool)
                for i, c in enumerate(cls.tolist()):
                    if c and c not in met:
                        met.add(c)
                        sent[i] = True
                place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
                keep = np.repeat(np.where(sent, size - -(-size * percent // 100) + 1, 0), size) > place
                owner_kept = owner[keep]
                v, own = _rare_first(owner, value, table)[keep], cls[owner_kept]
                salts = (2.0 ** ((v >> 55) / 4) / longest).astype(np.int64) if longest else np.zeros(len(v), np.int64)
                salt = np.where(salts > 0, 1 + (own & ((1 << 31) - 1)) % np.maximum(salts + 1, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(salt.astype(np.int32)), pa.array(own), pa.array(place[keep] << 31 | size[owner_kept])], schema=schema)

    return docs.select("text").mapInArrow(index, "v long, salt int, cls long, info long")


def _listed(index: DataFrame, salted: bool) -> DataFrame:
    """(v, cls, info, hub_cls, hub_info): every list's classes but its hub, the class in which the shingle comes first.

    Lists of one class vanish. The hub of a list that was dealt out over salts is the first of its parts' hubs.
    """
    keys = ["v", "salt"] if salted else ["v"]
    by_list = Window.partitionBy(*keys).orderBy("info", "cls")
    hub = {f"hub_{c}": F.first(c).over(by_list.rowsBetween(Window.unboundedPreceding, 0)) for c in ("cls", "info")}
    rows = index.repartition(*keys).select(*keys, "cls", "info", F.lag("cls").over(by_list).alias("last"), *(h.alias(k) for k, h in hub.items()))
    columns = ["v", "cls", "info", "hub_cls", "hub_info"]
    alone = rows.where("cls <> hub_cls and cls <> last").select(*columns)  # equal sets lie side by side
    if not salted:
        return alone
    dealt = rows.where("salt > 0 and (last is null or cls <> last)").select("v", "cls", "info", "hub_cls", "hub_info")
    first = dealt.groupBy("v").agg(F.min(F.struct(F.col("hub_info").alias("i"), F.col("hub_cls").alias("c"))).alias("hub"))
    counts = cut(dealt.groupBy("v").count())
    hot = hot_keys(counts, counts.agg(F.sum("count")).first()[0] or 0)
    joined = dealt_join(dealt.select("v", "cls", "info"), first, "v", hot, "cls").select("v", "cls", "info", F.col("hub.c").alias("hub_cls"), F.col("hub.i").alias("hub_info"))
    return rows.where("salt = 0 and cls <> hub_cls and cls <> last").select(*columns).unionAll(joined.where("cls <> hub_cls"))


def _could_link(percent: int):
    """Length filter, and positional filter: what is left of both sets from this shingle on must reach the overlap needed."""
    size = {s: F.col(f"{s}_info").bitwiseAND((1 << 31) - 1) for s in "xy"}
    left = {s: size[s] - F.shiftright(f"{s}_info", 31) for s in "xy"}
    need = F.ceil((size["x"] + size["y"]) * percent / (100 + percent))
    return (F.least(size["x"], size["y"]) * 100 >= F.greatest(size["x"], size["y"]) * percent) & (F.least(left["x"], left["y"]) >= need)


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(a: np.ndarray, b: np.ndarray, depth: int = SUFFIX_DEPTH) -> int:
    """A lower bound of the number of values that only one of two sorted sets has: the suffix filter.

    The middle value of one set cuts both; whatever lies on one side can only be shared with that side, so each side differs by
    its difference in size at least. Both sides are cut again, down to `depth`.
    """
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    middle = b[len(b) // 2]
    at, inside = int(np.searchsorted(a, middle)), False
    inside = at < len(a) and a[at] == middle
    half = len(b) // 2
    return _apart(a[:at], b[:half], depth - 1) + _apart(a[at + inside :], b[half + 1 :], depth - 1) + (not inside)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets link; the suffix filter spares most of those that do not the whole comparison."""
    if _apart(a, b) > len(a) + len(b) - 2 * -(-(len(a) + len(b)) * percent // (100 + percent)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass
class _Join:
    """The parts of one self-join.

    docs: doc_id, text and key, a hash of both. rows: (doc_id, n, cls) and carried columns of every document. classes: one
    row for each class, with the key of one of its documents and their number. listed: see `_listed`.
    """

    docs: DataFrame
    rows: DataFrame
    classes: DataFrame
    listed: DataFrame
    documents: int
    n: int
    percent: int

    def plausible(self, pairs: DataFrame, hot: list[tuple]) -> DataFrame:
        """The pairs whose sketches do not differ by more than linked sets may.

        A first, coarse suffix filter that needs no set at hand: a sketch cuts both sets, rare prefix and suffix alike, at the same places; what
        their counts differ by in every part is a lower bound of what the sets differ by. No pair that links is lost.
        """
        percent = self.percent
        side = {s: self.classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"}

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for k in (4, 5))
                most = n_a + n_b - 2 * -(-(n_a + n_b) * percent // (100 + percent))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]).filter(pa.array(np.abs(x - y).sum(axis=1) <= most))

        joined = dealt_join(dealt_join(pairs, side["a"], "a", hot, "b"), side["b"], "b", hot, "a")
        return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(compare, "a long, b long")

    def verified(self, pairs: DataFrame, few: bool, hot: list[tuple]) -> DataFrame:
        """The pairs that link, by the suffix filter and then the whole sets. Only the texts of one document for each class concerned are read again."""
        n, percent = self.n, self.percent
        asked = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct().join(self.classes, "cls").select("key")
        chosen = self.docs.join(F.broadcast(asked) if few else asked, "key", "left_semi")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, stop, data, bounds in text_slices(batch.column(0)):
                    owner, value = _shingles(data, bounds, n)
                    size, cls = _signatures(owner, value, stop - first)
                    raw, end = value.tobytes(), np.cumsum(size).tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([raw[8 * a : 8 * b] for a, b in zip([0, *end], end)], pa.binary())], names=["cls", "hashes"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [_linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), percent) for pair in zip(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        found = chosen.select("text").mapInArrow(sets, "cls long, hashes binary").groupBy("cls").agg(F.first("hashes").alias("hashes"))
        side = {s: found.select(F.col("cls").alias(s), F.col("hashes").alias(f"hashes_{s}")) for s in "ab"}
        joined = dealt_join(dealt_join(pairs, side["a"], "a", hot, "b"), side["b"], "b", hot, "a")
        return joined.select("a", "b", "hashes_a", "hashes_b").mapInArrow(verify, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the sketches and then link."""
        pairs, many = cut_counted(pairs)
        # a class with many pairs does not get them all in one task
        hot = hot_keys(pairs.select("a").unionAll(pairs.select("b")).groupBy("a").count(), 2 * many) if many > HOT_ROWS else []
        left, many = cut_counted(self.plausible(pairs, hot))
        return self.verified(left, 2 * many <= MOST_BROADCAST, hot)


def _prepared(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, carry: Sequence[str] | None = None, longest: int | None = None) -> _Join:
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col, carry).withColumn("key", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(LEAST_BITS, (size // BUCKET_BYTES).bit_length()), MOST_BITS)
    scanned = staged(_scan(docs, n, bits))
    rows = scanned.where("part is null").drop("key", "sketch", *(c.split()[0] for c in COLUMNS.split(", ")))
    classes = staged(
        scanned.where("part is null and n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")).select("cls", "one.key", "doc_id", "n", "sketch", "copies")
    )
    documents = classes.agg(F.sum("copies")).first()[0] or 0
    counts = added(scanned.where("part is not null").select("part", "places", "counts"), 1 << bits)
    levels = np.minimum(np.rint(4 * np.log2(counts + 1.0)), 255).astype(np.uint8)
    longest = longest or max(HOT_ROWS, documents // 256)
    salted = bool((2.0 ** (levels.max() / 4) >= longest))
    level = spark.sparkContext.broadcast(levels.tobytes())
    listed = staged(_listed(_index(docs, n, percent, level, longest if salted else None), salted))
    return _Join(docs.select("doc_id", "text", "key"), rows, classes, listed, documents, n, percent)


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None, longest: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents that link through Jaccard similarity of at least percent / 100.

    A document's set holds its distinct runs of n words (A-Z in lower case); one with fewer words has its whole sequence
    as its only shingle, one without words (or with null text) has none and is its own component. component_id is the
    smallest id that links reach.

    1. A scan counts shingles by hash over all documents and names the class of each set; equal sets are one class.
    2. Every set's prefix, rarest shingles first, is indexed: sets that link share a prefix shingle. Shingles that one
       class alone has are dropped.
    3. Each list of classes has a hub, the class in which the shingle comes first: of near copies, the one with the fewest
       rare shingles of its own, as a rule the original. Each class is compared with the hubs of its lists; this is
       linear in the list.
    4. All other pairs of classes in a list whose components still differ follow, so no link that could join two components
       is left out. Length, positional, sketch and suffix filters come first, and a pair is verified once, on the whole sets.

    Nothing is capped. Hot keys (a class with many copies, a hub with many pairs, a list longer than `longest`, by default
    a 256th of all documents and 100,000 at least) are dealt out over several tasks. Classes and shingles are told apart
    by 64 and 55 bits of hash.

    Rows with equal ids or equal texts stay separate rows with one component; a null id takes the smallest other id of its
    component, or null; an empty table gives no rows; extra columns are not read, but those in `carry` go along as the struct column `carried`.
    """
    p = _prepared(docs, n, percent, id_col, text_col, carry, longest)
    could = _could_link(percent)
    to_hub = p.listed.select(F.col("cls").alias("x"), F.col("info").alias("x_info"), F.col("hub_cls").alias("y"), F.col("hub_info").alias("y_info"))
    tried = cut(_pairs(to_hub.where(could)))
    links = cut(p.links(tried))
    roots = cut(connected(links))
    placed = p.listed.select("v", F.col("cls").alias("x"), F.col("info").alias("x_info")).join(roots.select(F.col("node").alias("x"), "root"), "x", "left").select("v", "x", "x_info", F.coalesce("root", "x").alias("x_root"))
    of_several = cut(placed.groupBy("v").agg(F.min("x_root").alias("lo"), F.max("x_root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("v", "n"))
    hot = hot_keys(of_several, p.documents)
    mixed = staged(dealt_join(placed, of_several.select("v"), "v", hot, "x", "left_semi"))
    # the rows of a long list are dealt out, and each meets the whole list
    others = dealt_join(mixed, mixed.select("v", F.col("x").alias("y"), F.col("x_info").alias("y_info"), F.col("x_root").alias("y_root")), "v", hot, "x").where((F.col("x_root") < F.col("y_root")) & could)
    more, found = cut_counted(p.links(_pairs(others).join(tried, ["a", "b"], "left_anti")))
    if found:
        roots = cut(connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more)))

    rooted = roots.join(p.classes.select(F.col("cls").alias("node"), "doc_id"), "node")
    smallest = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    named = dealt_join(rooted, smallest.select("root", "component_id"), "root", hot_keys(smallest.select("root", "n"), p.documents), "node").select(F.col("node").alias("cls"), F.col("component_id").alias("linked"))
    # a class without links has its own smallest id
    named = p.classes.select("cls", "doc_id").join(named, "cls", "left").select("cls", F.coalesce("linked", "doc_id").alias("component_id"))
    rows = dealt_join(p.rows, named, "cls", hot_keys(p.classes.select("cls", "copies"), p.documents), "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["carried"] if carry is not None else []))


def linked_pairs(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((a, b), (doc_id, representative)): every link between different sets, as their representatives' ids, and the membership.

    The whole join, where similar_documents only finds components: rows grow with the links themselves, so a group of k
    near copies may give k * k / 2. Documents with equal sets link, too, and have one representative, the smallest id. Documents without words have none.
    A set all of whose documents have a null id has a null representative: its links have a null b (and a null a, where neither set has an id).
    """
    p = _prepared(docs, n, percent, id_col, text_col)
    whole = p.listed.select("v", "cls", "info").unionAll(p.listed.select("v", F.col("hub_cls").alias("cls"), F.col("hub_info").alias("info")).distinct())
    x, y = (whole.select("v", F.col("cls").alias(s), F.col("info").alias(f"{s}_info")) for s in "xy")
    links = p.links(_pairs(x.join(y, "v").where((F.col("x") < F.col("y")) & _could_link(percent))))
    ids = p.classes.select("cls", "doc_id")
    named = links.join(ids.withColumnsRenamed({"cls": "a", "doc_id": "i"}), "a").join(ids.withColumnsRenamed({"cls": "b", "doc_id": "j"}), "b")
    members = p.rows.join(ids.withColumnRenamed("doc_id", "representative"), "cls", "left").select("doc_id", "representative")
    return named.select(F.least("i", "j").alias("a"), F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), F.greatest("i", "j")).alias("b")), members
