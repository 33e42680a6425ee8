"""Helpers on one raster at a time, in numpy only; no Spark in here."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from math import isqrt, sqrt

import numpy as np

_SATURATION = np.concatenate([[0.0], np.rint(1044480 / np.arange(1, 256))]).astype(np.int64)


def saturation_value(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit saturation and value of an RGB raster."""
    high, low = rgb.max(axis=-1).astype(np.int64), rgb.min(axis=-1).astype(np.int64)
    return ((high - low) * _SATURATION[high] + 2048 >> 12).astype(np.uint8), high.astype(np.uint8)


def otsu(counts: np.ndarray) -> int:
    """The value that splits a histogram into two classes of the greatest variance between them; the first of several."""
    p = counts / counts.sum()
    q = np.cumsum(p)
    m = np.cumsum(p * np.arange(len(p)))
    ok = (np.minimum(q, 1 - q) >= np.finfo(np.float32).eps)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where(ok, q * (1 - q) * (m / q - (m[-1] - m) / (1 - q)) ** 2, 0.0)
    return int(np.argmax(between))


def _slide(mask: np.ndarray, k: int, pick: Callable, outside: int, first: int) -> np.ndarray:
    """The extreme of each k x k window, by one pass down and one up in blocks of k along each axis, whatever k is."""
    for axis in (0, 1):
        lines = np.moveaxis(mask, axis, 0)
        n = len(lines)
        blocks = -(-(n + k - 1) // k)
        wide = np.full((blocks * k, lines.shape[1]), outside, mask.dtype)
        wide[first : first + n] = lines
        wide = wide.reshape(blocks, k, -1)
        down = pick.accumulate(wide, axis=1).reshape(blocks * k, -1)
        up = pick.accumulate(wide[:, ::-1], axis=1)[:, ::-1].reshape(blocks * k, -1)
        mask = np.moveaxis(pick(up[:n], down[k - 1 : k - 1 + n]), 0, axis)
    return np.ascontiguousarray(mask)


def erode(mask: np.ndarray, k: int, outside: int = 1) -> np.ndarray:
    """Erosion by a k x k square; pixels outside count as `outside`."""
    return _slide(mask, k, np.minimum, outside, k // 2)


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation by the mirrored k x k square, so that it undoes an erosion by an even one in place."""
    return _slide(mask, k, np.maximum, 0, k - 1 - k // 2)


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    return dilate(erode(mask, k), k)


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    return _slide(_slide(mask, k, np.maximum, 0, k - 1 - k // 2), k, np.minimum, 1, k // 2)


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels from 1 in order of each component's first pixel, areas) of the 8-connected components of a binary raster.

    Rows are cut into runs, runs that touch in neighbouring rows are linked, and links are followed by pointer jumping.
    """
    mask = mask > 0
    wide = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    n = len(row)
    if not n:
        return np.zeros(mask.shape, np.int64), np.empty(0, np.int64)
    width = mask.shape[1] + 2
    lo = np.searchsorted(row * width + end, (row - 1) * width + start)  # runs of the row before that end at or behind this start
    hi = np.searchsorted(row * width + start, (row - 1) * width + end, "right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    _, label = np.unique(root, return_inverse=True)
    area = np.bincount(label, end - start).astype(np.int64)
    out = np.zeros(mask.shape[0] * mask.shape[1] + 1, np.int64)
    np.add.at(out, row * mask.shape[1] + start, label + 1)
    np.add.at(out, row * mask.shape[1] + end, -(label + 1))
    return np.cumsum(out)[:-1].reshape(mask.shape), area


def keep_components(mask: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """The components of least to most pixels."""
    label, area = components(mask)
    good = (area >= least) & (area <= (most if most is not None else mask.size))
    return np.concatenate([[False], good])[label].astype(np.uint8)


def window_sums(values: np.ndarray) -> Callable:
    """A function of (y0, y1, x0, x1) arrays that gives the sums of half-open rectangles, from one table of running sums."""
    total = np.zeros((values.shape[0] + 1, values.shape[1] + 1), np.int64)
    total[1:, 1:] = np.cumsum(np.cumsum(values.astype(np.int64), axis=0), axis=1)
    return lambda y0, y1, x0, x1: total[y1, x1] - total[y0, x1] - total[y1, x0] + total[y0, x0]


def interface(label: np.ndarray) -> np.ndarray:
    """Pixels of class 1 with a neighbour of class 2, and the other way round (8 neighbours)."""
    one, two = (label == 1).astype(np.uint8), (label == 2).astype(np.uint8)
    return ((one & dilate(two, 3)) | (two & dilate(one, 3))).astype(bool)


def within(mask: np.ndarray, radius: float, scale: float) -> np.ndarray:
    """Pixels whose Euclidean distance to the nearest pixel of mask, times scale, is at most radius.

    Exact: the largest squared distance allowed is an integer; the vertical distance to the mask gives each column's reach
    in each row, and the reaches of a row are put together by a difference array.
    """
    height, width = mask.shape
    if not mask.any():
        return np.zeros(mask.shape, bool)
    most = int((radius / scale) ** 2)
    while sqrt(most) * scale > radius:
        most -= 1
    while sqrt(most + 1) * scale <= radius:
        most += 1
    rows = np.arange(height)[:, None]
    far = 4 * (height + width)
    above = np.maximum.accumulate(np.where(mask, rows, -far), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, far)[::-1], axis=0)[::-1]
    vertical = np.minimum(rows - above, below - rows).astype(np.int64)
    reach = np.array([isqrt(most - g * g) if g * g <= most else -1 for g in range(height + 1)])
    reach = np.where(vertical <= height, reach[np.minimum(vertical, height)], -1)
    y, x = np.nonzero(reach >= 0)
    w = reach[y, x]
    change = np.zeros((height, width + 1), np.int64)
    np.add.at(change, (y, np.maximum(x - w, 0)), 1)
    np.add.at(change, (y, np.minimum(x + w + 1, width)), -1)
    return np.cumsum(change, axis=1)[:, :width] > 0


#: Steps of the 5 x 5 chamfer distance (straight, diagonal, knight's move) in 16.16 fixed point.
CHAMFER = (65536, 91750, 143976)


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest pixel off the mask by 5 x 5 chamfer steps; the border of the raster is no such pixel."""
    straight, diagonal, knight = CHAMFER
    height, width = mask.shape
    big = np.int64(1) << 40
    out = np.where(mask > 0, big, 0).astype(np.int64)
    slope = straight * np.arange(width)

    def from_above(out: np.ndarray) -> np.ndarray:
        for y in range(height):
            best = out[y].copy()
            for dy, moves in ((1, ((-2, knight), (-1, diagonal), (0, straight), (1, diagonal), (2, knight))), (2, ((-1, knight), (1, knight)))):
                if y - dy >= 0:
                    for dx, cost in moves:
                        src = out[y - dy, max(dx, 0) : width + min(dx, 0)] + cost
                        to = best[max(-dx, 0) : width + min(-dx, 0)]
                        np.minimum(to, src, out=to)
            out[y] = np.minimum.accumulate(best - slope) + slope
        return out

    down = from_above(out)
    return np.minimum(from_above(down[::-1, ::-1].copy())[::-1, ::-1], big) / 65536.0


#: Pixels that are flooded in turn in the time of one step of all wavefronts, about.
STEP_PIXELS = 50


def split_touching(mask: np.ndarray, share: float, rounds: int) -> np.ndarray:
    """Touching objects set apart: pixels deeper than a share of the deepest are seeds, which flood the rest of the objects.

    Flooding goes in order of arrival over 4 neighbours, first inside the objects and then over their rim; where two seeds
    meet a pixel stays off, and so does the frame of the raster.
    """
    mask = (mask > 0).astype(np.uint8)
    if not mask.any():
        return mask
    depth = chamfer(mask).astype(np.float32)
    sure = depth > np.float32(share) * depth.max()
    seeds, areas = components(sure)
    if not len(areas):
        return mask
    around = mask
    for _ in range(rounds):
        around = dilate(around, 3)
    unknown = (around > 0) & ~sure
    marker = np.where(sure, seeds + 1, np.where(unknown, 0, 1))  # 1 is the background
    marker[0, :] = marker[-1, :] = marker[:, 0] = marker[:, -1] = -1
    region, sizes = components(marker == 0)
    small = np.append(False, sizes <= _small_regions(sizes))[region]
    marks = flooded(marker, mask, np.where(small, region, 0))
    return (flooded_in_turn(marks, mask, (region > 0) & ~small) > 1).astype(np.uint8)


def _small_regions(sizes: np.ndarray) -> int:
    """The size up to which regions are flooded together, in as many steps as the largest of them has pixels at most; the others have so many that one after another is faster."""
    ordered = np.sort(sizes)
    cost = ordered.sum() - np.cumsum(ordered) + STEP_PIXELS * ordered
    best = int(np.argmin(cost)) if len(cost) else 0
    return int(ordered[best]) if len(cost) and cost[best] < ordered.sum() else 0


def _first_queue(marks: np.ndarray, shade: np.ndarray, open_px: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the open pixels beside a marked one, whether none of these has their shade)."""
    near = open_px[:, None] + steps
    marked = marks[near] > 0
    beside = marked.any(axis=1)
    same = (marked & (shade[near] == shade[open_px][:, None])).any(axis=1)
    return open_px[beside], ~same[beside]


def flooded(marker: np.ndarray, mask: np.ndarray, region: np.ndarray) -> np.ndarray:
    """marker with its zeros flooded where region (from 1) is not 0, in ranked wavefronts over all regions at once.

    Regions do not touch, so each has queues of its own: one of pixels that came from a pixel of their shade, and one of the
    others, of which the next is taken only when the first is empty. A step takes from every region all pixels that wait in its first
    queue, or else one of its second. Pixels of a step are ranked by their places in the queue: one whose neighbours have
    two labels is off, as is one beside a pixel of lower rank that gets another label; a pixel that several could
    push is pushed by the first of them. So every region comes out as if its pixels were taken one by one.
    """
    height, width = marker.shape
    marks, shade, own = marker.reshape(-1).copy(), mask.reshape(-1), region.reshape(-1)
    steps = np.array((-1, 1, -width, width))
    n = int(own.max(initial=0)) + 1
    following = np.full(height * width, -1, np.int64)  # in the second queue of its region
    head, tail = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    rank_of = np.full(height * width, -1, np.int64)
    queued = np.zeros(height * width, bool)

    def wait(px: np.ndarray) -> None:
        """px go to the end of the second queues, in order."""
        order = np.argsort(own[px], kind="stable")
        px, r = px[order], own[px[order]]
        same = r[1:] == r[:-1]
        following[px[:-1][same]] = px[1:][same]
        first, last = px[np.append(True, ~same)], px[np.append(~same, True)]
        r = own[first]
        old = head[r] >= 0
        following[tail[r[old]]] = first[old]
        head[r[~old]] = first[~old]
        tail[r] = last

    px, other = _first_queue(marks, shade, np.flatnonzero((marks == 0) & (own > 0)), steps)
    queued[px] = True
    wave = px[~other]
    if len(px[other]):
        wait(px[other])
    regions = np.unique(own[px])
    while True:
        resting = np.setdiff1d(regions, own[wave], assume_unique=False) if len(wave) else regions
        resting = resting[head[resting] >= 0]
        taken = head[resting]
        head[resting] = following[taken]
        px = np.concatenate([wave, taken])
        if not len(px):
            return marks.reshape(marker.shape)
        regions = np.unique(own[px])
        near = px[:, None] + steps
        found = marks[near]
        high = found.max(axis=1)
        low = np.where(found > 0, found, high[:, None]).min(axis=1)
        kept = low == high
        rank_of[px] = np.arange(len(px))
        rank = rank_of[near]
        rank_of[px] = -1
        before = (rank >= 0) & (rank < np.arange(len(px))[:, None]) & kept[:, None]
        before &= kept[rank] & (low[rank] != low[:, None])
        open_rows = np.flatnonzero(before.any(axis=1))
        known = np.ones(len(px), bool)
        known[open_rows] = False
        while len(open_rows):  # each round decides those whose rivals of lower rank are decided
            rivals, r = before[open_rows], rank[open_rows]
            lost = (rivals & known[r] & kept[r]).any(axis=1)
            settled = lost | ~(rivals & ~known[r]).any(axis=1)
            kept[open_rows[lost]] = False
            known[open_rows[settled]] = True
            open_rows = open_rows[~settled]
        marks[px] = np.where(kept, low, -1)
        pushed = near[kept].reshape(-1)
        by = np.repeat(px[kept], 4)
        free = np.flatnonzero((marks[pushed] == 0) & ~queued[pushed] & (own[pushed] > 0))
        _, first = np.unique(pushed[free], return_index=True)
        free = free[np.sort(first)]
        pushed, by = pushed[free], by[free]
        queued[pushed] = True
        same = shade[pushed] == shade[by]
        wave = pushed[same]
        if not same.all():
            wait(pushed[~same])


def flooded_in_turn(marker: np.ndarray, mask: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """marker with its zeros inside flooded one pixel after another, as a few large regions have few pixels in a step. Regions do not touch, so they may share the queues."""
    width = marker.shape[1]
    marks, shade = marker.reshape(-1).tolist(), mask.reshape(-1).tolist()
    queues: tuple[deque, deque] = (deque(), deque())
    queued = bytearray(len(marks))
    steps = (-1, 1, -width, width)
    for p, other in zip(*(x.tolist() for x in _first_queue(marker.reshape(-1), mask.reshape(-1), np.flatnonzero(inside & (marker == 0)), np.array(steps)))):
        queued[p] = 1
        queues[other].append(p)
    while queues[0] or queues[1]:
        p = queues[0].popleft() if queues[0] else queues[1].popleft()
        found = {marks[p + s] for s in steps if marks[p + s] > 0}
        if len(found) > 1:
            marks[p] = -1
            continue
        marks[p] = found.pop()
        for q in (p + s for s in steps):
            if marks[q] == 0 and not queued[q]:
                queued[q] = 1
                queues[shade[q] != shade[p]].append(q)
    return np.array(marks).reshape(marker.shape)


def starts(length: int, patch: int, stride: int) -> list[int]:
    """Where patches begin so that they cover a length."""
    if length <= patch:
        return [0]
    return sorted({*range(0, length - patch + 1, stride), length - patch})


def infer(rgb: np.ndarray, model: Callable, patch: int, stride: int, batch: int, pick: Callable = lambda p: p) -> np.ndarray:
    """Half-precision maxima, by pixel and class, of a model's answers to overlapping patches; smaller rasters are padded with 0.

    model takes float32 patches between 0 and 1 and returns their probabilities (the first of several outputs counts).
    """
    height, width = rgb.shape[:2]
    places = [(y, x) for y in starts(height, patch, stride) for x in starts(width, patch, stride)]
    wide = np.zeros((max(height, patch), max(width, patch), 3), rgb.dtype)
    wide[:height, :width] = rgb
    out = None
    for first in range(0, len(places), batch):
        part = places[first : first + batch]
        tiles = np.stack([wide[y : y + patch, x : x + patch] for y, x in part]).astype(np.float32) / np.float32(255)
        answer = model(tiles)
        answer = pick(np.asarray(answer[0] if isinstance(answer, (list, tuple)) else answer)).astype(np.float16)
        if out is None:
            out = np.zeros((height, width, *answer.shape[3:]), np.float16)
        for (y, x), tile in zip(part, answer):
            at = out[y : y + patch, x : x + patch]
            np.maximum(at, tile[: at.shape[0], : at.shape[1]], out=at)
    return out


def foreground(answer: np.ndarray) -> np.ndarray:
    """The foreground's probability: the only channel, or the second."""
    if answer.ndim != 4 or not answer.shape[-1]:
        raise ValueError(f"unexpected shape {answer.shape}")
    return answer[..., min(1, answer.shape[-1] - 1)]


def resized(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with half-pixel centres, edges repeated and halves rounded up; a raster of that size stays as it is."""
    if rgb.shape[:2] == (height, width):
        return rgb
    out = rgb.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        at = (np.arange(n) + 0.5) * rgb.shape[axis] / n - 0.5
        low = np.floor(at).astype(np.int64)
        share = (at - low).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        last = rgb.shape[axis] - 1
        out = np.take(out, np.clip(low, 0, last), axis) * (1 - share) + np.take(out, np.clip(low + 1, 0, last), axis) * share
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def overlay(rgb: np.ndarray, color: np.ndarray, alpha: float) -> np.ndarray:
    """A weighted sum at every pixel, also where the colour is black."""
    return np.clip(np.rint(rgb * (1.0 - alpha) + color * alpha), 0, 255).astype(np.uint8)
