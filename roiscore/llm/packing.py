"""Sum-of-squares online packing of tokenized documents into windows of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from roiscore.llm.common import id_and_text, text_slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


#: Byte-level spelling of bytes (fixed values of byte-level BPE vocabularies): printable Latin-1 stands for itself, the rest follows from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LATIN_END = "\u0250"


class _Known(dict):
    """Word bytes to id bytes; a word that is neither there nor among the older ones is encoded."""

    def __init__(self, tokenizer):
        self.tokenizer, self.merge, self.older = tokenizer, tokenizer.model.tokenize, {}
        self.packed = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values()) + 1)]

    def age(self) -> None:
        """All words become older ones, in place of those that were; words that are met again come back from there."""
        self.older = self.copy()
        self.clear()

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encoded(word)
        self[word] = found
        return found

    def encoded(self, word: bytes) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if core.isalpha():  # ASCII letters only
            spelt = core.lower().decode()
        else:
            text = core.decode("utf-8", "replace")
            if not text.isalpha() or max(text) >= _LATIN_END or "\u0130" in text:
                return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
            spelt = text.lower().encode().decode("latin-1").translate(_SPELT)
        packed = self.packed
        found = b"".join([packed[t.id] for t in self.merge(spelt)])
        return found + self[word[len(core) :]] if len(core) < len(word) else found


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, for a lower-case byte-level BPE file whose pieces end with words (as
    `word_bpe_49k.json`), with a cache of words.

    Such a file drops white space and no id reaches over it, so a text's ids are those of its words, one after another;
    words are cut at ASCII blanks. Letters of Latin scripts before ASCII punctuation go to the file's merges at once, as
    they are composed already and make one token and the punctuation another; all other words take the file's whole way.
    """

    #: Words met since the cache last aged; as many older ones are kept.
    MOST_WORDS = 150_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = _Known(Tokenizer.from_file(path))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.MOST_WORDS:
            self.known.age()
        get = self.known.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Places pieces of documents into windows of `capacity` ids.

    Levels are fills in steps of `grain` ids. `count[h]` is the number of partly filled windows at level h. A piece goes
    where the sum of count[h]**2 afterwards is least (a new window, or the latest window of a level in which it fits);
    ties go to the fuller window. Windows with less than one grain left take the head of the next document, so each
    window cuts at most one document. No more than `most_open` windows stay open: beyond that, and at the end, the
    emptiest are cut up to fill the fullest. What is left in the last window is dealt out in powers of two, which need no padding.
    """

    def __init__(self, capacity: int, grain: int, most_open: int, first_sequence: int):
        self.capacity, self.grain, self.most_open, self.sequence = capacity, grain, most_open, first_sequence
        levels = -(-capacity // grain)
        self.count = np.zeros(levels, np.int64)
        self.top = np.full(levels, capacity + 1, np.int64)  # fill of the latest window of each level
        self.open: list[list[list]] = [[] for _ in range(levels)]  # windows are [fill, pieces]
        self.nearly: list[list] = []
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, total, self.sequence, at, ids))
            at += n
        self.sequence += 1

    def put(self, window: list) -> None:
        if window[0] == self.capacity:
            self.close(window[1])
        elif self.capacity - window[0] < self.grain:
            self.nearly.append(window)
        else:
            level = window[0] // self.grain
            self.open[level].append(window)
            self.count[level] += 1
            self.top[level] = window[0]

    def take(self, level: int) -> list:
        window = self.open[level].pop()
        self.count[level] -= 1
        self.top[level] = self.open[level][-1][0] if self.open[level] else self.capacity + 1
        return window

    def level_for(self, n: int) -> int:
        """The level whose latest window takes n ids at the least sum of squares; -1 for a new window."""
        fill = self.top + n
        best, least = -1, 0 if self.capacity - n < self.grain else 2 * int(self.count[n // self.grain]) + 1
        fits = np.flatnonzero(fill <= self.capacity)
        if len(fits):
            after = fill[fits]
            level = np.minimum(after // self.grain, len(self.count) - 1)
            change = 1 - 2 * self.count[fits] + np.where(self.capacity - after < self.grain, 0, 2 * self.count[level] + 1)
            change[(level == fits) & (self.capacity - after >= self.grain)] = 0
            if change.min() <= least:
                best = int(fits[np.flatnonzero(change == change.min())[-1]])
        return best

    def add(self, doc: int, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        if self.nearly and total >= self.capacity - self.nearly[-1][0]:
            fill, pieces = self.nearly.pop()
            at = self.capacity - fill
            self.close([*pieces, (doc, 0, ids[: 4 * at], total)])
        while total - at >= self.capacity:
            self.close([(doc, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        if n := total - at:
            level = self.level_for(n)
            window = self.take(level) if level >= 0 else [0, []]
            self.put([window[0] + n, [*window[1], (doc, at, ids[4 * at :], total)]])
            if self.count.sum() + len(self.nearly) > self.most_open:
                self.settle()

    def settle(self) -> None:
        """Fill the fullest windows with cuts of the emptiest; at most one stays open."""
        windows = sorted([*self.nearly, *(w for level in self.open for w in level)], key=lambda w: w[0])
        self.nearly, self.open = [], [[] for _ in self.open]
        self.count[:], self.top[:] = 0, self.capacity + 1
        while len(windows) > 1:
            target = windows.pop()
            while target[0] < self.capacity and windows:
                source = windows[0]
                doc, start, ids, total = source[1].pop()
                n = min(len(ids) // 4, self.capacity - target[0])
                target[1].append((doc, start, ids[: 4 * n], total))
                target[0] += n
                source[0] -= n
                if 4 * n < len(ids):
                    source[1].append((doc, start + n, ids[4 * n :], total))
                if not source[0]:
                    windows.pop(0)
            if target[0] == self.capacity:
                self.close(target[1])
            else:
                windows.append(target)
        for window in windows:
            self.put(window)

    def finish(self) -> None:
        self.settle()
        for fill, pieces in [*self.nearly, *(w for level in self.open for w in level)]:
            size = self.capacity
            while fill:
                while size > fill:
                    size //= 2
                part, need = [], size
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    n = min(need, len(ids) // 4)
                    part.append((doc, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                    need -= n
                self.close(part)
                fill -= size
        self.nearly, self.open = [], [[] for _ in self.open]

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW.types)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", grain: int = 64, most_open: int = 256) -> DataFrame:
    """Pieces of all documents, laid into sequences of at most `capacity` ids.

    A document is its ids followed by `end_id`. Columns: doc_id, start (ids of the document before the piece), length,
    doc_tokens, sequence_id, offset (ids of the sequence before the piece), ids (little-endian unsigned 32-bit).
    `capacity` is a power of two; sequences of other lengths than powers of two do not occur.

    Every partition packs on its own, without a shuffle, so a lost executor only repeats its own partitions; sequence
    ids carry the partition's number and are unique. Null or empty text is one piece with the end id alone; rows with
    equal or null ids are packed like any other rows; an empty table gives no rows; extra columns are not read.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        packer = Packer(capacity, min(grain, capacity), most_open, TaskContext.get().partitionId() << 40)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, stop, data, bounds in text_slices(batch.column(1)):
                raw = data.tobytes()
                for name, ids in zip(names[first:stop], tokenizer.ids([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])):
                    packer.add(name, ids + end)
                if packer.rows:
                    yield packer.drain()
        packer.finish()
        yield packer.drain()

    return id_and_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)
