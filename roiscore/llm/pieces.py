"""SentencePiece encoding by vectorised rounds of merges, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roiscore.llm.common import id_and_text, text_slices

SCHEMA = "doc_id long, ids binary, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_NONE = np.int64(1) << 40  # the rank of a pair that does not merge
_MARK = "▁"


class PieceTokenizer:
    """Byte-pair merges of a SentencePiece BPE model with byte fallback, over many words at once.

    The library gives the vocabulary, the normalisation and the decoder; the merges are done here. Symbols of all words
    lie in one flat array. A round finds the best pair of every word (segmented minimum of the pairs' ranks), merges its
    leftmost occurrences, as many as the library would merge one after another, with them every pair that is settled, and drops the merged symbols; words without a pair leave the array.

    A pair is settled where neither neighbour, however it grows, can take one of its symbols first, nor join the merged
    piece at a better rank than the pair's own. So what it merges into does not depend on when, and the result is always the
    library's, in few rounds for long words, too. Of a run of one symbol every second pair is settled, from the left.
    """

    MOST_WORDS = 300_000
    LONGEST_KEPT = 64
    ROUND_CHARS = 200_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.size, ids = size, {text[i]: i for i in normal}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(model.is_byte, self.byte_ids)):
            raise ValueError("the model has no byte fallback")
        symbols = dict(ids)
        for piece in ids:
            for char in piece:
                symbols.setdefault(char, size + len(symbols) - len(ids))  # a character that is only a part of pieces
        self.part_only = {i: c for c, i in symbols.items() if i >= size}
        self.width = np.int64(size + len(self.part_only) + 1)
        self.chars = {c: i for c, i in symbols.items() if len(c) == 1}
        score = {i: model.get_score(i) for i in normal}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = [(symbols[p[:k]] * int(self.width) + symbols[p[k:]], order[score[i]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        pairs.sort()
        self.key, self.rank, self.merged = (np.array(c, np.int64) for c in zip(*pairs))
        grown: dict[str, tuple[list, list]] = {"left": ([], []), "right": ([], [])}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    for side, key in (*(("left", symbols[p[j:k]] * int(self.width) + symbols[p[k:]]) for j in range(1, k) if p[j:k] in symbols), *(("right", symbols[p[:k]] * int(self.width) + symbols[p[k:j]]) for j in range(k + 1, len(p)) if p[k:j] in symbols)):
                        grown[side][0].append(key)
                        grown[side][1].append(order[score[i]])
        # the best rank that a pair may reach once its left (right) symbol has grown to the left (right)
        self.grown = {side: self._least(*map(np.array, v)) for side, v in grown.items()}
        alone = all(_MARK not in p.lstrip(_MARK) for p in ids) and all("\n" not in p for p in ids if len(p) > 1)
        self.word = re.compile(f"\n|{_MARK}*[^{_MARK}\n]+|{_MARK}+" if alone else r"(?s).+")
        self.known: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    @staticmethod
    def _least(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys and the least rank of each."""
        order = np.lexsort((rank, key))
        key, rank = key[order].astype(np.int64), rank[order].astype(np.int64)
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        return key[first], rank[first]

    def later(self, side: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The best rank of left and right together once the symbol on that side has grown."""
        keys, ranks = self.grown[side]
        if not len(keys):
            return np.full(len(left), _NONE)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], _NONE)

    def settled(self, flat: np.ndarray, rank: np.ndarray, merged: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of settled pairs; first: where words begin. A word's last symbol has no rank."""
        before, after = np.append(_NONE, rank[:-1]), np.append(rank[1:], _NONE)
        at = np.flatnonzero((rank < _NONE) & (rank <= before) & (rank <= after))
        if not len(at):
            return at
        begins = np.zeros(len(flat) + 1, bool)
        begins[first] = begins[-1] = True
        own, new, has_left, has_right = rank[at], merged[at], ~begins[at], ~begins[at + 2]
        good = np.ones(len(at), bool)
        for here, side, step in ((has_left, "left", -1), (has_right, "right", 1)):
            k = np.flatnonzero(here & good)
            near, far = (at[k], at[k] - 1) if step < 0 else (at[k] + 1, at[k] + 2)
            turn = (lambda a, b: (a, b)) if step < 0 else (lambda a, b: (b, a))
            takes, joins = (self.later(side, *turn(flat[far], x)) for x in (flat[near], new[k]))
            good[k] = self.pair(*turn(flat[far], new[k]))[0] > own[k]
            # a neighbour that grows into trouble does so by a pair of its own that comes first
            risky = np.flatnonzero(good[k] & ((takes <= own[k]) | (joins <= own[k])))
            f, r = far[risky], own[k[risky]]
            inner = np.flatnonzero(~begins[f if step < 0 else f + 1])
            f, r = f[inner], r[inner]
            grows = np.minimum(rank[f - 1] if step < 0 else rank[f], self.later(side, *turn(flat[f + step], flat[f]))) <= r
            good[k[risky[inner[grows]]]] = False
        run = np.zeros(len(at), bool)  # the same pair stands one place before, too
        run[1:] = (at[1:] == at[:-1] + 1) & (own[1:] == own[:-1]) & (new[1:] == new[:-1])
        good &= run | (before[at] > own)
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(run, 0, place))
        bad = np.maximum.accumulate(np.where(good, -1, place))
        return at[(bad < start) & ((place - start) % 2 == 0)]

    def leftmost(self, flat: np.ndarray, merged: np.ndarray, owner: np.ndarray, hits: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the places of every word's best pair those that the library merges one after another, from the left, before any other pair.

        It goes on to the next of them as long as a merged piece makes no pair, with the symbol before or behind it, that is as good. So
        each word's places are taken up to the first that makes one; of places side by side every second one is.
        """
        place = np.arange(len(hits))
        start = np.maximum.accumulate(np.where(np.append(True, np.diff(hits) > 1), place, 0)) if len(hits) else place
        at = hits[(place - start) % 2 == 0]
        word, new = owner[at], merged[at]
        wide = np.append(flat, -1)
        before = np.where((at > 0) & (owner[at - 1] == word), flat[at - 1], -1)
        beside = np.flatnonzero(np.append(False, np.diff(at) == 2) & np.append(False, word[1:] == word[:-1]))
        before[beside] = new[beside - 1]
        behind = np.where((at + 2 < len(flat)) & (np.append(owner, -1)[np.minimum(at + 2, len(flat))] == word), wide[np.minimum(at + 2, len(flat))], -1)
        as_good = np.zeros(len(at), bool)
        for left, right, other in ((before, new, before), (new, behind, behind)):
            k = np.flatnonzero((other >= 0) & (other < self.width))
            as_good[k] |= self.pair(left[k], right[k])[0] <= best[word[k]]
        seen = np.cumsum(as_good) - as_good
        first = np.append(True, word[1:] != word[:-1])[: len(at)]
        return at[seen == np.maximum.accumulate(np.where(first, seen, 0))] if len(at) else at

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of non-empty words."""
        size, more = int(self.width), {}
        flat = np.array([self.chars[c] if c in self.chars else more.setdefault(c, size + len(more)) for c in "".join(words)], np.int64)
        count = np.array([*map(len, words)], np.int64)
        word = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known = flat < size  # other characters take part in no pair
        rank, merged = np.full(len(flat), _NONE), np.zeros(len(flat), np.int64)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(count) - 1] = False
        at = np.flatnonzero(inner & known & np.append(known[1:], False))
        rank[at], merged[at] = self.pair(flat[at], flat[at + 1])
        while len(word):
            first = np.cumsum(count) - count
            best = np.minimum.reduceat(rank, first)
            if (over := best == _NONE).any():
                gone = np.repeat(over, count)
                done.append((word[over], count[over], flat[gone]))
                flat, rank, merged = flat[~gone], rank[~gone], merged[~gone]
                word, count, best = word[~over], count[~over], best[~over]
                if not len(word):
                    break
                first = np.cumsum(count) - count
            owner = np.repeat(np.arange(len(word)), count)
            chosen = np.zeros(len(flat), bool)
            chosen[self.leftmost(flat, merged, owner, np.flatnonzero(rank == best[owner]), best)] = True
            chosen[self.settled(flat, rank, merged, first)] = True
            hits = np.flatnonzero(chosen)
            flat[hits] = merged[hits]
            keep = np.ones(len(flat), bool)
            keep[hits + 1] = False
            last = np.zeros(len(flat), bool)
            last[np.cumsum(count) - 1] = True
            ends = np.zeros(len(flat), bool)
            ends[hits] = last[hits + 1]
            last |= ends
            count = count - np.bincount(owner[hits], minlength=len(word))
            place = np.cumsum(keep) - 1
            flat, rank, merged, last = flat[keep], rank[keep], merged[keep], last[keep]
            new = place[hits]
            starts = np.cumsum(count) - count
            before = new[new > starts[owner[hits]]] - 1
            touched = np.unique(np.concatenate([new, before]))
            rank[touched] = _NONE
            touched = touched[~last[touched]]
            touched = touched[(flat[touched] < size) & (flat[touched + 1] < size)]
            rank[touched], merged[touched] = self.pair(flat[touched], flat[touched + 1])
        return self.spell(done, {i: c for c, i in more.items()}, len(words))

    def spell(self, done: list[tuple], more: dict[int, str], n: int) -> list[bytes]:
        """Finished words in order; symbols that are no piece become the ids of their bytes."""
        word, count, flat = (np.concatenate(x) for x in zip(*done))
        if (odd := flat >= self.size).any():
            owner = np.repeat(np.arange(len(word)), count)
            other = self.part_only | more
            spelt = {i: [self.byte_ids[b] for b in other[i].encode()] for i in np.unique(flat[odd]).tolist()}
            length = np.ones(len(flat), np.int64)
            length[odd] = [len(spelt[i]) for i in flat[odd].tolist()]
            wide = np.repeat(flat, length)
            wide[np.repeat(odd, length)] = [b for i in flat[odd].tolist() for b in spelt[i]]
            flat, count = wide, np.bincount(owner, length, len(word)).astype(np.int64)
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
        out: list[bytes] = [b""] * n
        for w, a, b in zip(word.tolist(), [0, *ends], ends):
            out[w] = raw[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without begin and end, as little-endian unsigned 32-bit integers."""
        words = [self.word.findall(self.model.normalize(t)) for t in texts]
        distinct = set().union(*words)
        found = self.known
        if new := sorted(distinct.difference(found), key=len):
            if len(found) + len(new) > self.MOST_WORDS:
                found = {w: found[w] for w in distinct if w in found}
            at = 0
            while at < len(new):
                stop, chars = at, 0
                while stop < len(new) and (stop == at or chars + len(new[stop]) <= self.ROUND_CHARS):
                    chars += len(new[stop])
                    stop += 1
                found.update(zip(new[at:stop], self.merge(new[at:stop])))
                at = stop
        out = [b"".join(map(found.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > self.LONGEST_KEPT:
                del found[w]
        self.known = found
        return out


_tokenizers: dict[str, PieceTokenizer] = {}


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with begin and end, little-endian unsigned 32-bit) and the text that the model decodes from them.

    The model is a BPE model with byte fallback and without user-defined symbols. Every row is encoded on its own, without
    a shuffle. Null text counts as empty: begin and end alone, decoded as an empty text. Rows with equal or null ids are kept
    as they are; an empty table gives no rows; extra columns are not read.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = piece_tokenizer(model_path)
        model = tokenizer.model
        begin, end = (int(i).to_bytes(4, "little") for i in (model.bos_id(), model.eos_id()))
        for batch in batches:
            for first, stop, data, bounds in text_slices(batch.column(1)):
                raw = data.tobytes()
                ids = [begin + x + end for x in tokenizer.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])]
                decoded = model.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, stop - first), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=_ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(convert, SCHEMA)
