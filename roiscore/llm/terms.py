"""Terms of UTF-8 text, grouped by their bytes: boundaries from a lookup table, slices grouped by xxhash and compared byte by byte.

A term is a longest run of ASCII letters and bytes beyond ASCII, with only A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from roiscore.llm.words import lower, spans

#: Bytes that end a term: 0x00 to 0x40, 0x5B to 0x60 and 0x7B to 0x7F.
BREAKS = np.zeros(256, bool)
BREAKS[0x00:0x41] = BREAKS[0x5B:0x61] = BREAKS[0x7B:0x80] = True

#: The five primes of XXH64 (fixed values of the published algorithm).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Slices of so many bytes and more take the library's own way, one by one.
_LONG = 32


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(rows: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of each row of a matrix of bytes less than 32 wide: what xxhash.xxh64_intdigest gives, a column at a time."""
    n, width = rows.shape
    h = np.full(n, int(_P5) + width, np.uint64)
    at = 0
    for size, kind in ((8, "<u8"), (4, "<u4"), (1, "u1")):
        while width - at >= size:
            lane = np.ascontiguousarray(rows[:, at : at + size]).view(kind).ravel().astype(np.uint64)
            if size == 8:
                h = _rotate(h ^ (_rotate(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            elif size == 4:
                h = _rotate(h ^ (lane * _P1), 23) * _P2 + _P3
            else:
                h = _rotate(h ^ (lane * _P5), 11) * _P1
            at += size
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _same_rows(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct row, its number for every row): rows of one hash whose bytes differ are parted."""
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    if (rows == rows[first[number]]).all():
        return first, number
    _, first, number = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, number


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """(a slice that stands for each distinct one, its number for every slice), by width and hash, with all bytes compared."""
    number = np.empty(len(starts), np.int64)
    stands: list[np.ndarray] = []
    n = 0
    width = ends - starts
    order = np.argsort(width, kind="stable")
    cuts = np.flatnonzero(np.diff(width[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        size = int(width[own[0]])
        if size < _LONG:
            rows = data[starts[own][:, None] + np.arange(size)]
            first, inner = _same_rows(rows, hashed(rows))
        else:  # few; the dictionary of a hash compares the bytes
            seen: dict[int, dict[bytes, int]] = {}
            inner, first = np.empty(len(own), np.int64), []
            for k, s in enumerate(starts[own].tolist()):
                piece = data[s : s + size].tobytes()
                same = seen.setdefault(xxhash.xxh64_intdigest(piece), {})
                if piece not in same:
                    same[piece] = len(first)
                    first.append(k)
                inner[k] = same[piece]
            first = np.array(first, np.int64)
        stands.append(own[first])
        number[own] = inner + n
        n += len(first)
    return np.concatenate(stands) if stands else np.empty(0, np.int64), number


def term_counts(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, and rows of term, group, occurrences, documents) of documents that lie end to end in data; group is a number for each document."""
    data = lower(data)
    starts, ends, first = spans(data, bounds, BREAKS)
    stands, number = distinct(data, starts, ends)
    whole = data.tobytes()
    terms = pa.array([whole[s:e] for s, e in zip(starts[stands].tolist(), ends[stands].tolist())], pa.binary())
    if not len(stands):
        return terms, *(np.empty(0, np.int64) for _ in range(4))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    # a sparse matrix of documents by terms, one entry for each pair that occurs
    entry, times = np.unique(doc * len(stands) + number, return_counts=True)
    row, column = entry // len(stands), entry % len(stands)
    # and of groups by terms, whose entries are sums of runs of its sorted entries
    key = group[row] * len(stands) + column
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return terms, key[at] % len(stands), key[at] // len(stands), np.add.reduceat(times, at), np.diff(np.append(at, len(key)))


def pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Parts of one document of about `most` bytes, cut where a term ends; a term longer than that is in one part."""
    at = 0
    while at < len(data):
        stop = min(at + most, len(data))
        while stop < len(data):
            if len(gap := np.flatnonzero(BREAKS[data[stop : stop + most]])):
                stop += int(gap[0])
                break
            stop = min(stop + most, len(data))
        yield data[at:stop]
        at = stop
