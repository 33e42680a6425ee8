"""Raster helpers on hand-drawn rasters and against brute force."""

import heapq
import itertools
import time
from math import sqrt

import numpy as np
import pytest

from roiscore.functions import raster


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if label[start]:
            continue
        n += 1
        stack = [start]
        label[start] = n
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p = (y + dy, x + dx)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                        label[p] = n
                        stack.append(p)
    return label, np.bincount(label.reshape(-1), minlength=n + 1)[1:]


@pytest.mark.parametrize("seed", range(40))
def test_components_against_flooding(seed):
    rng = np.random.default_rng(seed)
    mask = (rng.random(rng.integers(1, 24, 2)) < rng.choice([0.2, 0.45, 0.7])).astype(np.uint8)
    label, area = raster.components(mask)
    expected, areas = flood(mask)
    assert label.shape == mask.shape and (area.tolist(), label.tolist()) == (areas.tolist(), expected.tolist())


@pytest.mark.parametrize("seed", range(40))
def test_distance_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random(rng.integers(1, 20, 2)) < 0.05
    radius, scale = float(rng.choice([1.0, 2.0, 2.5, 5.0, 150.0])), float(rng.choice([0.5, 1.0, 0.2527]))
    ys, xs = np.nonzero(mask)
    expected = [[any(sqrt((y - a) ** 2 + (x - b) ** 2) * scale <= radius for a, b in zip(ys, xs)) for x in range(mask.shape[1])] for y in range(mask.shape[0])]
    assert raster.within(mask, radius, scale).tolist() == expected


def test_chamfer_against_plain_passes():
    rng = np.random.default_rng(3)
    a, b, c = raster.CHAMFER
    steps = [(0, -1, a), (-1, -2, c), (-1, -1, b), (-1, 0, a), (-1, 1, b), (-1, 2, c), (-2, -1, c), (-2, 1, c)]
    for _ in range(20):
        mask = rng.random((rng.integers(2, 15), rng.integers(2, 15))) < 0.85
        if mask.all():
            continue
        d = np.where(mask, 1 << 40, 0)
        h, w = mask.shape
        for sign, ys, xs in ((1, range(h), range(w)), (-1, range(h - 1, -1, -1), range(w - 1, -1, -1))):
            for y in ys:
                for x in xs:
                    for dy, dx, cost in steps:
                        p, q = y + sign * dy, x + sign * dx
                        if 0 <= p < h and 0 <= q < w:
                            d[y, x] = min(d[y, x], d[p, q] + cost)
        assert (raster.chamfer(mask) == d / 65536).all()


def test_opening_and_erosion_treat_the_border_differently():
    ones = np.ones((12, 9), np.uint8)
    assert (raster.closed(raster.opened(ones, 5), 5) == ones).all()
    eroded = raster.erode(ones, 5, outside=0)
    assert eroded[2:-2, 2:-2].all() and eroded.sum() == 8 * 5
    square = np.zeros((12, 12), np.uint8)
    square[4:8, 4:8] = 1
    assert not raster.opened(square, 5).any()
    assert (raster.opened(square, 2) == square).all()


def test_component_sizes_and_diagonals():
    mask = np.zeros((8, 8), np.uint8)
    mask[0, 0] = mask[1, 1] = 1
    mask[4, :4] = 1
    mask[6, :5] = 1
    assert raster.components(mask)[1].tolist() == [2, 4, 5]
    assert raster.keep_components(mask, 5).sum() == 5 and raster.keep_components(mask, 3, 4).sum() == 4
    assert raster.components(np.zeros((3, 3)))[1].size == 0


def test_interface_of_a_boundary():
    label = np.ones((5, 6), np.uint8)
    label[:, 3:] = 2
    assert raster.interface(label).sum() == 10
    assert not raster.interface(np.ones((4, 4), np.uint8)).any()


def disc(shape, y, x, r):
    a, b = np.ogrid[: shape[0], : shape[1]]
    return (a - y) ** 2 + (b - x) ** 2 <= r * r


def test_touching_discs_are_set_apart():
    mask = (disc((60, 90), 30, 30, 15) | disc((60, 90), 30, 60, 15)).astype(np.uint8)
    assert len(raster.components(mask)[1]) == 1
    apart = raster.split_touching(mask, 0.35, 2)
    assert len(raster.components(apart)[1]) == 2


def test_small_disc_beside_a_large_one_vanishes():
    mask = (disc((60, 90), 30, 30, 20) | disc((60, 90), 30, 75, 3)).astype(np.uint8)
    apart = raster.split_touching(mask, 0.35, 2)
    assert apart[30, 30] and not apart[30, 75]
    empty = np.zeros((5, 5), np.uint8)
    assert (raster.split_touching(empty, 0.35, 2) == empty).all()


@pytest.mark.parametrize("shape", [(260, 300), (100, 200), (256, 256), (33, 700)])
def test_tiling_does_not_change_the_answer(shape):
    rgb = np.random.default_rng(1).integers(0, 256, (*shape, 3), np.uint8)
    whole = (rgb.astype(np.float32) / np.float32(255)).astype(np.float16)
    assert (raster.infer(rgb, lambda t: [t, "ignored"], 256, 192, 4) == whole).all()


def test_plan_of_a_full_region():
    starts = raster.starts(2048, 256, 192)
    assert starts == [*range(0, 1729, 192), 1792] and raster.starts(100, 256, 192) == [0]


def test_half_precision_decides():
    assert np.float16(0.49990) >= 0.5 and np.float16(0.4998) < 0.5
    rgb = np.zeros((4, 4, 3), np.uint8)
    answer = raster.infer(rgb, lambda t: np.full((*t.shape[:3], 1), 0.4999), 4, 4, 1, raster.foreground)
    assert (answer >= 0.5).all()
    with pytest.raises(ValueError):
        raster.foreground(np.zeros((1, 2, 2, 0)))


def test_resize_by_hand():
    rgb = np.array([[0, 100], [100, 200]], np.uint8)[..., None].repeat(3, 2)
    assert raster.resized(rgb, 2, 2) is rgb
    assert raster.resized(rgb, 4, 4)[0, :, 0].tolist() == [0, 25, 75, 100]


def test_overlay_darkens_off_the_mask():
    rgb = np.full((1, 2, 3), 200, np.uint8)
    color = np.array([[[0, 0, 0], [255, 0, 0]]], np.uint8)
    assert raster.overlay(rgb, color, 0.3).tolist() == [[[140, 140, 140], [216, 140, 140]]]


def test_otsu_takes_the_first_of_equals():
    counts = np.zeros(256, int)
    counts[10] = counts[200] = 50
    assert raster.otsu(counts) == 10


def plain_split(mask, share, rounds):
    """The same flooding pixel by pixel: distances by shortest paths, then a queue by change of shade and arrival."""
    height, width = mask.shape
    inside = lambda y, x: 0 <= y < height and 0 <= x < width
    moves = {(dy, dx): c for dy in range(-2, 3) for dx in range(-2, 3) for s, c in (((0, 1), 65536), ((1, 1), 91750), ((1, 2), 143976)) if tuple(sorted((abs(dy), abs(dx)))) == s}
    depth = {(y, x): 0 for y in range(height) for x in range(width) if not mask[y, x]}
    line = [(0, p) for p in depth]
    heapq.heapify(line)
    while line:
        d, (y, x) = heapq.heappop(line)
        if d > depth[y, x]:
            continue
        for (dy, dx), c in moves.items():
            q = (y + dy, x + dx)
            if inside(*q) and mask[q] and d + c < depth.get(q, 1 << 60):
                depth[q] = d + c
                heapq.heappush(line, (d + c, q))
    values = {p: np.float32(d / 65536) for p, d in depth.items()}
    sure = {p for p, d in values.items() if d > np.float32(share) * max(values.values())}
    seed, number = {}, 1
    for p in sorted(sure):
        if p not in seed:
            number += 1
            seed[p], line = number, [p]
            while line:
                y, x = line.pop()
                for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                    if q in sure and q not in seed:
                        seed[q] = number
                        line.append(q)
    around = {p for p in depth if mask[p]}
    for _ in range(rounds):
        around |= {(y + dy, x + dx) for y, x in around for dy in (-1, 0, 1) for dx in (-1, 0, 1) if inside(y + dy, x + dx)}
    frame = {p for p in depth if p[0] in (0, height - 1) or p[1] in (0, width - 1)}
    mark = {p: -1 if p in frame else seed.get(p, 0 if p in around else 1) for p in depth}
    near = lambda y, x: ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))
    queue, queued, arrivals = [], set(), itertools.count()

    def push(p):
        queued.add(p)
        heapq.heappush(queue, (min(abs(int(mask[p]) - int(mask[q])) for q in near(*p) if mark[q] > 0), next(arrivals), p))

    for p in sorted(depth):
        if mark[p] == 0 and any(mark[q] > 0 for q in near(*p)):
            push(p)
    while queue:
        _, _, p = heapq.heappop(queue)
        found = {mark[q] for q in near(*p) if mark[q] > 0}
        mark[p] = found.pop() if len(found) == 1 else -1
        if mark[p] > 0:
            for q in near(*p):
                if mark[q] == 0 and q not in queued:
                    push(q)
    return np.array([[mark[y, x] > 1 for x in range(width)] for y in range(height)], np.uint8)


@pytest.mark.parametrize("seed", range(12))
def test_objects_are_set_apart_as_by_a_plain_flooding(seed):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:26, :34]
    mask = np.zeros((26, 34), np.uint8)
    for _ in range(int(rng.integers(2, 7))):
        cy, cx, r = rng.integers(2, 24), rng.integers(2, 32), rng.integers(2, 7)
        mask |= ((y - cy) ** 2 + (x - cx) ** 2 <= r * r).astype(np.uint8)
    share, rounds = (0.35, 2) if seed % 2 else (0.6, 1)
    assert (raster.split_touching(mask, share, rounds) == plain_split(mask, share, rounds)).all()


@pytest.mark.parametrize("k", range(2, 32))
def test_sliding_extremes_against_all_shifts(k):
    """Also where the square is larger than the raster."""
    rng = np.random.default_rng(k)
    for shape in ((1, 1), (7, 40), (40, 33)):
        values = rng.integers(0, 256, shape, dtype=np.uint8)
        for first, outside, pick, helper in ((k // 2, 1, np.minimum, raster.erode(values, k)), (k - 1 - k // 2, 0, np.maximum, raster.dilate(values, k))):
            wide = np.pad(values, ((first, k - 1 - first),) * 2, constant_values=outside)
            plain = pick.reduce([wide[i : i + shape[0], j : j + shape[1]] for i in range(k) for j in range(k)])
            assert (helper == plain).all()


def blobs(rng, size, n, most):
    """Discs that touch and overlap."""
    mask = np.zeros((size, size), np.uint8)
    y, x = np.ogrid[:size, :size]
    for _ in range(n):
        cy, cx, r = rng.integers(0, size, 2).tolist() + [int(rng.integers(2, most))]
        a, b, c, d = max(cy - r, 0), cy + r + 1, max(cx - r, 0), cx + r + 1
        mask[a:b, c:d] |= ((y[a:b] - cy) ** 2 + (x[:, c:d] - cx) ** 2 <= r * r).astype(np.uint8)
    return mask


@pytest.mark.parametrize("seed", range(200))
def test_wavefronts_equal_a_plain_flooding(seed, monkeypatch):
    monkeypatch.setattr(raster, "STEP_PIXELS", (0, 5, 50)[seed % 3])
    rng = np.random.default_rng(seed)
    size = int(rng.integers(3, 60))
    mask = (rng.random((size, size)) < rng.random()).astype(np.uint8) if seed % 2 else blobs(rng, size, int(rng.integers(1, 12)), 9)
    mask[0, 0] = 0  # the plain form has no distance without a pixel off
    share, rounds = float(rng.choice([0.2, 0.35, 0.6, 0.9])), int(rng.integers(0, 4))
    assert (raster.split_touching(mask, share, rounds) == plain_split(mask, share, rounds)).all()


@pytest.mark.parametrize("seed", range(20))
def test_regions_in_turn_and_in_wavefronts_agree(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    mask = blobs(rng, 70, 25, 9)
    expected = plain_split(mask, 0.35, 2)
    for least in (0, 10**9):
        monkeypatch.setattr(raster, "_small_regions", lambda sizes, least=least: least or int(rng.integers(0, 400)))
        assert (raster.split_touching(mask, 0.35, 2) == expected).all()


def test_a_full_region_of_many_objects_is_fast():
    mask = blobs(np.random.default_rng(0), 2048, 6000, 9)
    began = time.perf_counter()
    raster.split_touching(mask, 0.35, 2)
    assert time.perf_counter() - began < 6  # about 2 s on a machine at rest
