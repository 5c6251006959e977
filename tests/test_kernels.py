from __future__ import annotations

import itertools
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow import kernels as K

BOX = st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 30), st.integers(1, 30)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


def test_assignment_is_cheapest() -> None:
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.random((n, m))
        rows, columns = K.assign(cost)
        assert len(set(rows.tolist())) == len(set(columns.tolist())) == min(n, m)
        flat = cost if n <= m else cost.T
        best = min(sum(flat[i, p[i]] for i in range(flat.shape[0])) for p in itertools.permutations(range(flat.shape[1]), flat.shape[0]))
        assert abs(cost[rows, columns].sum() - best) < 1e-9
    assert len(K.assign(np.zeros((0, 3)))[0]) == 0


@settings(deadline=None, max_examples=60)
@given(BOX, BOX)
def test_iou(a, b) -> None:
    v = K.box_iou(np.array([a]), np.array([b]))[0, 0]
    assert v == K.box_iou(np.array([b]), np.array([a]))[0, 0] and 0 <= v <= 1 and K.box_iou(np.array([a]), np.array([a]))[0, 0] == 1


@settings(deadline=None, max_examples=60)
@given(st.lists(BOX, max_size=12))
def test_merging_ends_and_is_stable(boxes) -> None:
    merged = K.merge_boxes(np.array(boxes, float).reshape(-1, 4))
    assert np.array_equal(K.merge_boxes(merged), merged) and len(merged) <= len(boxes)


@settings(deadline=None, max_examples=40)
@given(st.lists(BOX, max_size=8))
def test_union_area(boxes) -> None:
    grid = np.zeros((100, 100), bool)
    for x1, y1, x2, y2 in boxes:
        grid[y1:y2, x1:x2] = True
    assert K.union_area(np.array(boxes, float).reshape(-1, 4)) == grid.sum()


def test_merge_rules() -> None:
    # Covered to half, equal areas, apart, and a merge that makes another possible.
    assert K.merge_boxes(np.array([[0, 0, 10, 10], [0, 5, 10, 15]])).tolist() == [[0, 0, 10, 15]]
    assert len(K.merge_boxes(np.array([[0, 0, 10, 10], [9, 0, 19, 10]]))) == 2
    assert len(K.merge_boxes(np.array([[0, 0, 4, 4], [100, 0, 104, 4], [0, 0, 104, 4]]))) == 1


def test_masks() -> None:
    mask = K.rasterise(np.array([[1, 1], [1, 4], [4, 4], [4, 1]]), 8, 8)
    assert mask.sum() == 16 and mask[1:5, 1:5].all()
    assert K.rasterise(np.array([[2, 2]]), 5, 5).sum() == 1
    edge = K.boundary(mask)
    assert edge[1, 1] and edge[0, 1] and not edge[2, 2] and not edge[0, 0]
    same = K.mask_metrics(mask, mask)
    assert all(abs(v - 1) < 1e-6 for v in same.values())
    none = K.mask_metrics(np.zeros_like(mask), mask)
    assert none["iou"] == 0 and none["region_coverage"] == 0 and none["pixel_accuracy"] == 48 / 64


def test_matching_masks() -> None:
    square = lambda x, y: np.array([[x, y], [x, y + 5], [x + 5, y + 5], [x + 5, y]])
    pairs, stray, missed = K.match_masks([square(0, 0), square(20, 20)], [square(1, 0), square(10, 10)], 30, 30)
    assert [(t, r) for t, r, _ in pairs] == [(0, 0)] and stray == [1] and missed == [1]


def test_clipping() -> None:
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]])
    clipped = K.clip_polygon(square, square + 2)
    assert sorted(map(tuple, clipped.tolist())) == [(2, 2), (2, 4), (4, 2), (4, 4)]
    assert np.array_equal(K.clip_polygon(square, square + 50), square)
    assert len(K.clip_polygon(square, square[::-1])) == 4


def _area(ring: np.ndarray) -> float:
    return abs(float((ring[:, 0] * np.roll(ring[:, 1], -1) - np.roll(ring[:, 0], -1) * ring[:, 1]).sum())) / 2


def _inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of each point."""
    a, b = ring, np.roll(ring, -1, axis=0)
    x, y = points[:, :1], points[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        hits = ((a[:, 1] <= y) != (b[:, 1] <= y)) & (x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
    return hits.sum(axis=1) % 2 == 1


def test_areas_of_any_polygons_against_sampling() -> None:
    rng = np.random.default_rng(4)
    grid = np.stack(np.meshgrid(np.arange(0.05, 20, 0.1), np.arange(0.05, 20, 0.1)), axis=-1).reshape(-1, 2)
    for _ in range(40):
        sides = [[rng.integers(0, 21, (rng.integers(3, 8), 2)).astype(float) for _ in range(rng.integers(0, 4))] for _ in range(2)]
        t, r = (np.any([_inside(grid, p) for p in side] or [np.zeros(len(grid), bool)], axis=0) for side in sides)
        covered, whole = K.polygon_coverage(*sides)
        assert abs(whole - t.sum() / 100) < 3 and abs(covered - (t & r).sum() / 100) < 3
    assert K.polygon_coverage([np.array([(0, 0), (4, 0), (4, 4), (0, 4)])], [np.array([(2, 0), (9, 0), (9, 2), (2, 2)])]) == (4.0, 16.0)


def test_clipping_to_concave_windows() -> None:
    u = np.array([(0, 0), (10, 0), (10, 10), (7, 10), (7, 3), (3, 3), (3, 10), (0, 10)])
    bar = np.array([(-1, 5), (9, 5), (9, 7), (-1, 7)])
    part = K.clip_polygon(bar, u)  # a part of 3 x 2 on the left, of 2 x 2 on the right
    assert sorted(map(tuple, part.tolist())) == [(0.0, 5.0), (0.0, 7.0), (3.0, 5.0), (3.0, 7.0)]
    whole = K.clip_polygon(np.array([(-1, -1), (11, -1), (11, 11), (-1, 11)]), u)
    assert _area(whole) == _area(u.astype(float)) and len(whole) == 8
    assert K.clip_polygon(np.array([(20, 20), (21, 20), (21, 21)]), u).tolist() == [[20, 20], [21, 20], [21, 21]]
    rng = np.random.default_rng(5)
    for _ in range(60):
        angles = np.sort(rng.uniform(0, 2 * np.pi, 7))
        star = np.stack([8 + rng.uniform(2, 8, 7) * np.cos(angles), 8 + rng.uniform(2, 8, 7) * np.sin(angles)], axis=1)
        box = np.array([(3, 3), (12, 3), (12, 13), (3, 13)], float)
        part = K.clip_polygon(star, box)
        common = K.polygon_coverage([star], [box])[0]
        assert _area(part) <= common + 1e-4 and part[:, 0].min() >= 3 - 1e-6 and part[:, 1].max() <= 13 + 1e-6
        assert abs(_area(part) - common) < 1e-4 or _area(part) < common


def test_mask_pairs_against_whole_masks() -> None:
    rng = np.random.default_rng(5)
    for width, height in ((150, 90), (64, 64), (7, 200)):
        truth = [rng.uniform(-5, [width, height], 2) + rng.uniform(0, 40, (int(rng.integers(3, 7)), 2)) for _ in range(8)]
        read = [p + rng.uniform(0, 3, 2) for p in truth for _ in range(int(rng.integers(0, 3)))]
        t, r = ([K.rasterise(p, width, height) for p in side] for side in (truth, read))
        iou = np.array([[(a & b).sum() / ((a | b).sum() + 1e-10) for b in r] for a in t])
        want = {(i, j): K.mask_metrics(r[j], t[i]) for i, j in zip(*K.assign(-iou), strict=True) if iou[i, j] >= 0.3}
        pairs, stray, missed = K.match_masks(read, truth, width, height, 0.3)
        assert {(i, j): m for i, j, m in pairs} == want
        assert stray == sorted(set(range(len(read))) - {j for _, j in want}) and missed == sorted(set(range(len(truth))) - {i for i, _ in want})


def test_mask_pairs_cost_what_is_drawn() -> None:
    """80 lines on a page of 2400 by 3600 pixels; whole masks of every pair took 92 seconds."""
    lines = [np.array([[100, y], [2200, y + 5], [2200, y + 35], [100, y + 30]]) for y in range(20, 3540, 44)]
    began = time.process_time()
    pairs, stray, missed = K.match_masks([p + [3, 2] for p in lines], lines, 2400, 3600)
    assert len(pairs) == len(lines) == 80 and not stray and not missed and time.process_time() - began < 10


def test_best_pairs() -> None:
    rng = np.random.default_rng(2)
    for _ in range(300):
        gain = np.round(rng.random(rng.integers(1, 9, 2)), int(rng.integers(1, 9))) * (rng.random() < 0.8)
        a, b = np.nonzero(gain)
        found = K.best_pairs(a, b, gain[a, b])
        rows, columns = K.assign(-gain)
        assert len(set(a[found])) == len(set(b[found])) == len(found) and abs(gain[a, b][found].sum() - gain[rows, columns].sum()) < 1e-9
