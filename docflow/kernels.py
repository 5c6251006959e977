"""numpy kernels for what neither SQL nor Spark's functions express: assignment, merging, rasters, boundaries, clipping."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np

#: Keeps the shares of empty masks finite (fixed value).
_EPS = 1e-10
#: Places nearer than this are the same one, in pixels.
_NEAR = 1e-5
#: Pairs of edges that are compared at once.
_CELLS = 1 << 20
#: Pixels that are drawn at once.
_DRAWN = 1 << 20


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest one-to-one assignment (shortest augmenting paths with potentials, O(n^2 m))."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    turned = cost.shape[0] > cost.shape[1]
    if turned:
        cost = cost.T
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j]:
            done[j] = True
            slack = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            k = int(np.argmin(np.where(done[1:], np.inf, least[1:]))) + 1
            step = least[k]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
        while j:
            owner[j], j = owner[way[j]], way[j]
    columns = np.flatnonzero(owner[1:])
    rows = owner[1:][columns] - 1
    order = np.argsort(columns if turned else rows)
    return (columns[order], rows[order]) if turned else (rows[order], columns[order])


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of a with every box of b; 0 where both are empty."""
    a, b = np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4)
    sides = np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2])
    common = np.prod(np.maximum(sides, 0), axis=2)
    areas = [np.prod(x[:, 2:] - x[:, :2], axis=1) for x in (a, b)]
    union = areas[0][:, None] + areas[1][None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union != 0)


def _absorbs(kept: np.ndarray, box: np.ndarray, iou: float, cover: float) -> np.ndarray:
    """Which kept boxes take the box in: IoU above iou, or the smaller of the two covered to `cover`; of equal ones the kept counts as smaller."""
    x1, y1, x2, y2 = kept.T
    a1, b1, a2, b2 = box
    common = np.maximum(np.minimum(x2, a2) - np.maximum(x1, a1), 0) * np.maximum(np.minimum(y2, b2) - np.maximum(y1, b1), 0)
    own, other = (a2 - a1) * (b2 - b1), (x2 - x1) * (y2 - y1)
    small, union = np.where(own < other, own, other), own + other - common
    share = lambda whole: np.divide(common, whole, out=np.zeros(len(kept)), where=whole != 0)
    return (share(union) > iou) | (share(small) >= cover)


def merge_boxes(boxes: np.ndarray, iou: float = 0.2, cover: float = 0.5) -> np.ndarray:
    """Boxes merged in passes until a pass merges none: each box goes into the first kept box that absorbs it, else it is kept."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    while True:
        kept, n = np.empty_like(boxes), 0
        for box in boxes:
            takes = _absorbs(kept[:n], box, iou, cover)
            first = int(takes.argmax()) if n else 0
            if n and takes[first]:
                np.minimum(kept[first, :2], box[:2], out=kept[first, :2])
                np.maximum(kept[first, 2:], box[2:], out=kept[first, 2:])
            else:
                kept[n] = box
                n += 1
        if n == len(boxes):
            return kept
        boxes = kept[:n]


def rasterise(polygon: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mask (height, width) of a polygon, its outline included: even-odd scan lines through pixel centres, and each edge drawn."""
    points = np.asarray(polygon, float).reshape(-1, 2)
    mask = np.zeros((height, width), bool)
    if not len(points):
        return mask
    a, b = points, np.roll(points, -1, axis=0)
    for y in range(max(0, int(np.floor(points[:, 1].min()))), min(height, int(np.ceil(points[:, 1].max())) + 1)):
        cross = (a[:, 1] <= y) != (b[:, 1] <= y)
        at = np.sort(a[cross, 0] + (y - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1]))
        for low, high in zip(at[::2], at[1::2], strict=False):
            mask[y, max(0, int(np.ceil(low))) : max(0, int(np.floor(high)) + 1)] = True
    for (x1, y1), (x2, y2) in zip(a, b, strict=True):
        steps = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        xs, ys = np.rint(np.linspace(x1, x2, steps + 1)).astype(int), np.rint(np.linspace(y1, y2, steps + 1)).astype(int)
        inside = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        mask[ys[inside], xs[inside]] = True
    return mask


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels with a neighbour (up, down, left, right) of the other kind, on both sides of the edge."""
    out = np.zeros_like(mask)
    for axis in (0, 1):
        differs = np.diff(mask.astype(np.int8), axis=axis) != 0
        low = [slice(None)] * 2
        high = [slice(None)] * 2
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        out[tuple(low)] |= differs
        out[tuple(high)] |= differs
    return out


def mask_metrics(read: np.ndarray, truth: np.ndarray) -> dict[str, float]:
    """IoU, Dice, pixel accuracy, mean pixel accuracy, boundary F1 and coverage of the truth, by their textbook definitions."""
    both, size = float((read & truth).sum()), read.size
    p, t = float(read.sum()), float(truth.sum())
    none = size - p - t + both
    edge_read, edge_truth = boundary(read), boundary(truth)
    edge = float((edge_read & edge_truth).sum())
    precision, recall = edge / (edge_read.sum() + _EPS), edge / (edge_truth.sum() + _EPS)
    return {
        "iou": both / (p + t - both + _EPS),
        "dice": 2 * both / (p + t + _EPS),
        "pixel_accuracy": (both + none) / size,
        "mean_pixel_accuracy": (both / (t + _EPS) + none / (size - t + _EPS)) / 2,
        "boundary_f1": float(2 * precision * recall / (precision + recall + _EPS)),
        "region_coverage": both / t if t else 0.0,
    }


def match_masks(read: list[np.ndarray], truth: list[np.ndarray], width: int, height: int, least: float = 0.5) -> tuple[list[tuple[int, int, dict[str, float]]], list[int], list[int]]:
    """Pairs (truth, read, metrics) of the best one-to-one assignment by IoU with at least `least`, unmatched read and truth numbers."""
    shapes = [np.asarray(p, float).reshape(-1, 2) for p in (*truth, *read)]
    sizes = np.array([len(p) for p in shapes], int)
    page = np.zeros(len(shapes), int)
    t, r, metrics = match_pages(np.concatenate([*shapes, np.zeros((0, 2))]), sizes, page, np.arange(len(truth)), np.arange(len(truth), len(shapes)), np.array([width]), np.array([height]), least)
    pairs = [(int(i), int(j) - len(truth), {name: float(column[n]) for name, column in metrics.items()}) for n, (i, j) in enumerate(zip(t, r, strict=True))]
    return pairs, sorted(set(range(len(read))) - {j for _, j, _ in pairs}), sorted(set(range(len(truth))) - {i for i, _, _ in pairs})


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For as many items as each count says, the count's number and the item's place within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many values behind one another."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _runs(counts: np.ndarray, most: int) -> list[slice]:
    """Slices of counts that come to `most` each at most, or hold one count."""
    ends, out, low = np.cumsum(counts), [], 0
    while low < len(counts):
        high = max(int(np.searchsorted(ends, most + (ends[low - 1] if low else 0), side="right")), low + 1)
        out.append(slice(low, high))
        low = high
    return out


@dataclass(frozen=True)
class Masks:
    """Masks of polygons as rows of 64 pixels a word, each within its own window, which has a free pixel on all sides that aren't the page's."""

    words: np.ndarray
    start: np.ndarray  # of a mask's words
    column: np.ndarray  # first word of the window's rows, counted from the page's left
    span: np.ndarray  # words of a row
    top: np.ndarray
    rows: np.ndarray
    width: np.ndarray  # of the page
    area: np.ndarray


def draw_masks(points: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray) -> Masks:
    """The masks that rasterise gives, of many polygons of `sizes` points on pages of their own width and height."""
    first, some = np.cumsum(sizes) - sizes, sizes > 0
    low, high = (np.full((len(sizes), 2), fill) for fill in (0.0, -4.0))
    if some.any():
        low[some], high[some] = np.minimum.reduceat(points, first[some]), np.maximum.reduceat(points, first[some])
    left, top = (np.maximum(np.floor(low[:, i]).astype(int) - 2, 0) for i in (0, 1))
    right, bottom = (np.minimum(np.ceil(high[:, i]).astype(int) + 3, side) for i, side in ((0, width), (1, height)))
    shown = some & (right > left) & (bottom > top)
    column = left >> 6
    span, rows = np.where(shown, (right + 63 >> 6) - column, 0), np.where(shown, bottom - top, 0)
    parts = [_drawn(points[first[of.start] : first[of.stop - 1] + sizes[of.stop - 1]], sizes[of], width[of], height[of], column[of], span[of], top[of], rows[of]) for of in _runs(span * rows * 64 + 1, _DRAWN)]
    words = np.concatenate([*parts, np.zeros(0, np.uint64)])
    counts = span * rows
    return Masks(words, np.cumsum(counts) - counts, column, span, top, rows, width, _sums(np.bitwise_count(words), counts))


def _drawn(points: np.ndarray, sizes: np.ndarray, width: np.ndarray, height: np.ndarray, column: np.ndarray, span: np.ndarray, top: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of the masks of some polygons: the outlines pixel by pixel, then the scan lines a word at a time."""
    cells = span * rows * 64
    offset = np.cumsum(cells) - cells - top * span * 64 - column * 64  # of the page's first pixel
    owner, at = _ranges(sizes)
    after = np.arange(len(points)) + 1
    after[at == sizes[owner] - 1] -= sizes[sizes > 0]
    shown = rows[owner] > 0
    owner, (x1, y1), (x2, y2) = owner[shown], points[shown].T, points[after[shown]].T

    n = np.maximum(np.abs(x2 - x1), np.abs(y2 - y1)).astype(int) + 1
    counts = n + 1
    ends = np.cumsum(counts)
    k = np.arange(ends[-1] if len(ends) else 0, dtype=float)
    k -= np.repeat((ends - counts).astype(float), counts)
    pixels = []
    for low, high in ((x1, x2), (y1, y2)):
        at = k * np.repeat((high - low) / n, counts)
        at += np.repeat(low, counts)
        at[ends - 1] = high
        pixels.append(np.rint(at, out=at))
    x, y = pixels
    place = (y * np.repeat(span[owner] * 64.0, counts) + x + np.repeat(offset[owner].astype(float), counts)).astype(int)
    if (np.minimum(x1, x2) < 0).any() or (np.minimum(y1, y2) < 0).any() or (np.rint(np.maximum(x1, x2)) >= width[owner]).any() or (np.rint(np.maximum(y1, y2)) >= height[owner]).any():
        own = np.repeat(owner, counts)
        place = place[(x >= 0) & (x < width[own]) & (y >= 0) & (y < height[own])]
    mask = np.zeros(int(cells.sum()), bool)
    mask[place] = True
    words = np.packbits(mask, bitorder="little").view("<u8").astype(np.uint64, copy=False)

    begin = np.maximum(np.ceil(np.minimum(y1, y2)).astype(int), 0)
    end = np.minimum(np.ceil(np.maximum(y1, y2)).astype(int), height[owner])
    e, y = _ranges(np.maximum(end - begin, 0))
    y += begin[e]
    x, own = x1[e] + (y - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e]), owner[e]
    order = np.lexsort((x, (np.cumsum(rows) - rows - top)[own] + y))
    x, y, own = x[order].reshape(-1, 2), y[order][::2], own[order][::2]
    a, b = np.clip(np.ceil(x[:, 0]).astype(int), 0, width[own]), np.clip(np.floor(x[:, 1]).astype(int) + 1, 0, width[own])
    line, w = _ranges(np.where(a < b, (b + 63 >> 6) - (a >> 6), 0))
    w += a[line] >> 6
    low, high = (np.clip(side[line] - w * 64, 0, 64).astype(np.uint64) for side in (a, b))
    np.bitwise_or.at(words, (offset[own] >> 6)[line] + y[line] * span[own][line] + w, ~np.uint64(0) >> (np.uint64(64) - (high - low)) << low)
    return words


def boundaries(masks: Masks) -> Masks:
    """The boundary of each mask."""
    own, at = _ranges(masks.span * masks.rows)
    m, n, span = masks.words, np.arange(len(own)), masks.span[own]
    w = at % np.maximum(span, 1)
    one, top = np.uint64(1), np.uint64(63)
    beside = lambda words, step, there: np.where(there, words[np.clip(n + step, 0, max(len(n) - 1, 0))], np.uint64(0))
    # Differences to the pixel on the right, where the page has one.
    whole = np.clip(masks.width[own] - 1 - (masks.column[own] + w) * 64, 0, 64)
    onward = np.where(whole == 64, ~np.uint64(0), (one << np.minimum(whole, 63).astype(np.uint64)) - one)
    right = (m ^ (m >> one | beside(m, 1, w < span - 1) << top)) & onward
    below = (m ^ beside(m, span, True)) * (at // np.maximum(span, 1) < masks.rows[own] - 1)
    out = right | right << one | beside(right, -1, w > 0) >> top | below | beside(below, -span, at >= span)
    return replace(masks, words=out, area=_sums(np.bitwise_count(out), masks.span * masks.rows))


def common_area(masks: Masks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels that masks a and b of a page share, pair by pair."""
    left, top = np.maximum(masks.column[a], masks.column[b]), np.maximum(masks.top[a], masks.top[b])
    span = np.maximum(np.minimum(masks.column[a] + masks.span[a], masks.column[b] + masks.span[b]) - left, 0)
    counts = span * np.maximum(np.minimum(masks.top[a] + masks.rows[a], masks.top[b] + masks.rows[b]) - top, 0)
    parts = [np.zeros(0, np.int64)]
    for of in _runs(counts, _CELLS):
        pair, at = _ranges(counts[of])
        pair += of.start
        y, x = at // span[pair] + top[pair], at % span[pair] + left[pair]
        one, other = (masks.words[masks.start[i] + (y - masks.top[i]) * masks.span[i] + x - masks.column[i]] for i in (a[pair], b[pair]))
        parts.append(_sums(np.bitwise_count(one & other), counts[of]))
    return np.concatenate(parts)


def match_pages(points: np.ndarray, sizes: np.ndarray, page: np.ndarray, truth: np.ndarray, read: np.ndarray, width: np.ndarray, height: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Numbers of the truth and read polygons that each page's best one-to-one assignment by IoU pairs with at least `least`, and the metrics of the pairs.

    page: ascending numbers of the polygons' pages, width and height by page; truth, read: polygons of each side, by page.
    Masks keep to their windows and only those whose windows meet are compared, so a page costs what is drawn on it and not its own size a pair.
    """
    masks = draw_masks(points, sizes, width[page], height[page])
    # Every truth with each read of its page, where their windows meet.
    low, high = (np.searchsorted(page[read], page[truth], side=side) for side in ("left", "right"))
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for of in _runs(high - low, _CELLS):
        own, at = _ranges((high - low)[of])
        t, r = truth[own + of.start], read[at + low[own + of.start]]
        meet = (masks.top[t] < masks.top[r] + masks.rows[r]) & (masks.top[r] < masks.top[t] + masks.rows[t]) & (masks.column[t] < masks.column[r] + masks.span[r]) & (masks.column[r] < masks.column[t] + masks.span[t])
        found.append((t[meet], r[meet]))
    t, r = (np.concatenate(side) for side in zip(*found, strict=True))
    both = common_area(masks, t, r)
    t, r, both = t[both > 0], r[both > 0], both[both > 0]
    iou = both / (masks.area[t] + masks.area[r] - both + _EPS)
    kept = best_pairs(t, r, iou)
    kept = kept[iou[kept] >= least]
    t, r = t[kept], r[kept]
    return t, r, _pair_metrics(masks, boundaries(masks), t, r, both[kept].astype(float), (width * height)[page[t]])


def _pair_metrics(masks: Masks, edges: Masks, truth: np.ndarray, read: np.ndarray, both: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """mask_metrics of pairs."""
    p, t = masks.area[read].astype(float), masks.area[truth].astype(float)
    none = size - p - t + both
    edge = common_area(edges, truth, read).astype(float)
    precision, recall = edge / (edges.area[read] + _EPS), edge / (edges.area[truth] + _EPS)
    return {
        "iou": both / (p + t - both + _EPS),
        "dice": 2 * both / (p + t + _EPS),
        "pixel_accuracy": (both + none) / size,
        "mean_pixel_accuracy": (both / (t + _EPS) + none / (size - t + _EPS)) / 2,
        "boundary_f1": 2 * precision * recall / (precision + recall + _EPS),
        "region_coverage": np.divide(both, t, out=np.zeros_like(both), where=t != 0),
    }


def best_pairs(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b) of a one-to-one choice with the largest sum of gains, all above 0.

    Each a takes its best b; where several want one, shortest augmenting paths from there on, which look no further than they must.
    """
    if not len(a):
        return np.zeros(0, int)
    order = np.lexsort((b, -gain, a))
    heads = order[np.r_[True, a[order][1:] != a[order][:-1]]]
    sole = np.bincount(b[heads], minlength=int(b.max()) + 1)[b[heads]] == 1
    if sole.all():
        return heads
    # A group is what hangs together by pairs; those in which nobody's wish is another's are settled.
    group = _joined(a, b)
    open_ = np.isin(group, group[heads[~sole]])
    rest = np.flatnonzero(open_)
    return np.concatenate([heads[~open_[heads]], rest[_augmented(a[rest].tolist(), b[rest].tolist(), gain[rest].tolist())]])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for all pairs that hang together."""
    (left, x), (right, y) = (np.unique(v, return_inverse=True) for v in (a, b))
    root = np.arange(len(left))
    while True:
        least = np.full(len(right), len(left))
        np.minimum.at(least, y, root[x])
        new = root.copy()
        np.minimum.at(new, x, least[y])
        new = new[new]
        if (new == root).all():
            return root[x]
        root = new


def _augmented(a: list[int], b: list[int], gain: list[float]) -> list[int]:
    near: dict[int, list[tuple[int, float, int]]] = {}
    for n, (i, j, g) in enumerate(zip(a, b, gain, strict=True)):
        near.setdefault(i, []).append((j, g, n))
    u = {i: max(g for _, g, _ in js) for i, js in near.items()}
    v: dict[int, float] = {}
    owner: dict[int, int] = {}
    taken: dict[int, int] = {}  # pair of each a that has one
    late = []
    for i, js in near.items():
        j, _, n = max(js, key=lambda e: e[1])
        if j in owner:
            late.append(i)
        else:
            owner[j], taken[i] = i, n
    for first in late:
        # Least loss to each b, and to leaving an a without one.
        loss, via, done, heap = {}, {}, {}, []
        i, at = first, 0.0
        leave, leaver = u[first], first
        while True:
            for j, g, n in near[i]:
                if j not in done:
                    far = at + u[i] + v.get(j, 0.0) - g
                    if far < loss.get(j, np.inf):
                        loss[j], via[j] = far, (i, n)
                        heapq.heappush(heap, (far, j))
            while heap and (heap[0][1] in done or heap[0][0] > loss[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or leave <= heap[0][0]:
                total, goal, i = leave, None, leaver
                break
            at, j = heapq.heappop(heap)
            if j not in owner:
                total, goal = at, j
                break
            done[j] = at
            i = owner[j]
            if at + u[i] < leave:
                leave, leaver = at + u[i], i
        u[first] -= total
        for j, far in done.items():
            v[j] = v.get(j, 0.0) + total - far
            u[owner[j]] -= total - far
        if goal is None:
            # The one left out gives its b up.
            if i == first:
                continue
            goal = b[taken.pop(i)]
        while True:
            i, n = via[goal]
            before = taken.get(i)
            owner[goal], taken[i] = i, n
            if i == first:
                break
            goal = b[before]
    return list(taken.values())


def slabs(sides: list[list[np.ndarray]]) -> tuple[np.ndarray, list[list[list[tuple[int, int]]]], np.ndarray]:
    """The plane cut at every vertex and crossing of some polygons, so that no edges cross within a slab.

    Returns the heights of the cuts; for each slab and side the intervals (left and right edge) that its polygons cover
    together, each polygon inside by the even-odd rule; and the edges (x1, y1, x2, y2), rising.
    """
    edges, owner = [], []
    for number, polygon in enumerate(p for side in sides for p in side):
        points = np.asarray(polygon, float).reshape(-1, 2)
        edges.append(np.hstack([points, np.roll(points, -1, axis=0)]))
        owner.append(np.full(len(points), number))
    edges = np.concatenate([*edges, np.zeros((0, 4))])
    owner = np.concatenate([*owner, np.zeros(0, int)]).astype(int)
    rising = edges[:, 1] != edges[:, 3]
    edges, owner = edges[rising], owner[rising]
    falls = edges[:, 1] > edges[:, 3]
    edges[falls] = edges[falls][:, [2, 3, 0, 1]]
    d = edges[:, 2:] - edges[:, :2]
    ys = [np.zeros(0)]
    step = max(_CELLS // max(len(edges), 1), 1)
    for low in range(0, len(edges), step):
        own, e = edges[low : low + step], d[low : low + step]
        cross = e[:, None, 0] * d[None, :, 1] - e[:, None, 1] * d[None, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = edges[None, :, :2] - own[:, None, :2]
            t, u = ((gap[..., 0] * f[..., 1] - gap[..., 1] * f[..., 0]) / cross for f in (d[None, :], e[:, None]))
            met = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
            ys.append((own[:, None, 1] + t * e[:, None, 1])[met])
    heights = np.unique(np.concatenate([edges[:, [1, 3]].ravel(), *ys]))
    heights = heights[np.r_[True, np.diff(heights) > _NEAR]] if len(heights) else heights
    of_side = np.repeat(np.arange(len(sides)), [len(side) for side in sides])
    found = []
    for low, high in zip(heights[:-1], heights[1:], strict=True):
        middle = (low + high) / 2
        here = np.flatnonzero((edges[:, 1] < middle) & (edges[:, 3] > middle))
        here = here[np.argsort(x_at(edges[here], middle), kind="stable")]
        covered: list[list[tuple[int, int]]] = [[] for _ in sides]
        inside, depth, left = set(), [0] * len(sides), [0] * len(sides)
        for e in here.tolist():
            side = of_side[owner[e]]
            inside ^= {owner[e]}
            depth[side] += 1 if owner[e] in inside else -1
            if depth[side] == 1 and owner[e] in inside:
                left[side] = e
            elif depth[side] == 0:
                covered[side].append((left[side], e))
        found.append(covered)
    return heights, found, edges


def x_at(edges: np.ndarray, y: float) -> np.ndarray:
    return edges[..., 0] + (y - edges[..., 1]) * (edges[..., 2] - edges[..., 0]) / (edges[..., 3] - edges[..., 1])


def _common(a: list[tuple[int, int]], b: list[tuple[int, int]], edges: np.ndarray, y: float) -> list[tuple[int, int]]:
    """Intervals of a slab that two sides share."""
    out = []
    for l1, r1 in a:
        for l2, r2 in b:
            left = l1 if x_at(edges[l1], y) >= x_at(edges[l2], y) else l2
            right = r1 if x_at(edges[r1], y) <= x_at(edges[r2], y) else r2
            if x_at(edges[left], y) < x_at(edges[right], y):
                out.append((left, right))
    return out


def polygon_coverage(truth: list[np.ndarray], read: list[np.ndarray]) -> tuple[float, float]:
    """Areas of what the union of read covers of the union of truth, and of the union of truth, exact for any polygons."""
    heights, found, edges = slabs([truth, read])
    covered = whole = 0.0
    for low, high, (t, r) in zip(heights[:-1], heights[1:], found, strict=True):
        y = (low + high) / 2
        length = lambda intervals: sum(float(x_at(edges[b], y) - x_at(edges[a], y)) for a, b in intervals)  # noqa: E731, B023
        whole += (high - low) * length(t)
        covered += (high - low) * length(_common(t, r, edges, y))
    return covered, whole


def is_convex(points: np.ndarray) -> bool:
    """Whether a ring turns one way only, and once around."""
    d = np.roll(points, -1, axis=0) - points
    d = d[(d != 0).any(axis=1)]
    if len(d) < 3:
        return False
    turn = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    if (turn > 0).any() and (turn < 0).any():
        return False
    return abs(float(np.arctan2(turn, (d * np.roll(d, -1, axis=0)).sum(axis=1)).sum())) < 2.5 * np.pi


def _clip_convex(polygon: np.ndarray, window: np.ndarray) -> np.ndarray:
    """clip_polygon for convex shapes, a half-plane at a time."""
    x, y = window[:, 0], window[:, 1]
    if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() < 0:
        window = window[::-1]
    out = polygon
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        if (side >= 0).all():
            continue
        last, before = np.roll(out, 1, axis=0), np.roll(side, 1)
        crosses = side * before < 0
        share = np.divide(before, before - side, out=np.zeros_like(side), where=crosses)
        points = np.stack([last + (out - last) * share[:, None], out], axis=1).reshape(-1, 2)
        out = points[np.stack([crosses, side >= 0], axis=1).reshape(-1)]
        if len(out) < 3:
            return polygon
    return out


def clip_polygon(polygon: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The largest part of a polygon inside a window, both of any shape, as its outer ring; the polygon itself where they share no area."""
    own, window = np.asarray(polygon, float).reshape(-1, 2), np.asarray(window, float).reshape(-1, 2)
    if len(own) < 3:
        return own
    if is_convex(own) and is_convex(window):
        return _clip_convex(own, window)
    heights, found, edges = slabs([[own], [window]])
    pieces = []  # trapezoids: slab, left and right x below and above
    for k, (low, high, (a, b)) in enumerate(zip(heights[:-1], heights[1:], found, strict=True)):
        for left, right in _common(a, b, edges, (low + high) / 2):
            pieces.append((k, *(float(x_at(edges[e], y)) for y in (low, high) for e in (left, right))))
    if not pieces:
        return own
    pieces = _snapped(pieces)
    # Pieces that touch along a cut are one part.
    part = list(range(len(pieces)))

    def root(i: int) -> int:
        while part[i] != i:
            i = part[i]
        return i

    for i, p in enumerate(pieces):
        for j, q in enumerate(pieces):
            if q[0] == p[0] + 1 and min(p[4], q[2]) > max(p[3], q[1]):
                part[root(i)] = root(j)
    area: dict[int, float] = {}
    for i, p in enumerate(pieces):
        area[root(i)] = area.get(root(i), 0.0) + (heights[p[0] + 1] - heights[p[0]]) * (p[2] - p[1] + p[4] - p[3]) / 2
    largest = max(area, key=lambda r: (area[r], -r))
    return _outline([p for i, p in enumerate(pieces) if root(i) == largest], heights)


def _snapped(pieces: list[tuple]) -> list[tuple]:
    """The trapezoids with places of a cut that lie nearer than _NEAR made the same."""
    on: dict[int, list[float]] = {}
    for k, l1, r1, l2, r2 in pieces:
        on.setdefault(k, []).extend((l1, r1))
        on.setdefault(k + 1, []).extend((l2, r2))
    same: dict[int, dict[float, float]] = {}
    for cut, xs in on.items():
        last = None
        for x in sorted(set(xs)):
            last = x if last is None or x - last > _NEAR else last
            same.setdefault(cut, {})[x] = last
    return [(k, same[k][l1], same[k][r1], same[k + 1][l2], same[k + 1][r2]) for k, l1, r1, l2, r2 in pieces]


def _outline(pieces: list[tuple], heights: np.ndarray) -> np.ndarray:
    """The outer ring around trapezoids: their slanted sides, and along the cuts whatever has a trapezoid on one side only."""
    onward: dict[tuple[float, float], list[tuple[float, float]]] = {}

    def add(a: tuple[float, float], b: tuple[float, float]) -> None:
        if a != b:
            onward.setdefault(a, []).append(b)

    along: dict[float, list[tuple[float, float, int]]] = {}
    for k, l1, r1, l2, r2 in pieces:
        low, high = float(heights[k]), float(heights[k + 1])
        add((l2, high), (l1, low))
        add((r1, low), (r2, high))
        along.setdefault(low, []).append((l1, r1, 1))
        along.setdefault(high, []).append((l2, r2, -1))
    for y, spans in along.items():
        xs = sorted({x for l, r, _ in spans for x in (l, r)})
        for a, b in zip(xs, xs[1:], strict=False):
            above = any(l <= a and b <= r for l, r, s in spans if s == 1)
            below = any(l <= a and b <= r for l, r, s in spans if s == -1)
            if above and not below:
                add((a, y), (b, y))
            elif below and not above:
                add((b, y), (a, y))
    rings = []
    while onward:
        start = min(onward)
        ring, at = [start], start
        while True:
            nexts = onward[at]
            # Where rings touch, turn right most, which keeps to the outer one.
            before = ring[-2] if len(ring) > 1 else (at[0], at[1] + 1)
            back = np.arctan2(before[1] - at[1], before[0] - at[0])
            b = min(nexts, key=lambda n: (np.arctan2(n[1] - at[1], n[0] - at[0]) - back) % (2 * np.pi) or 2 * np.pi) if len(nexts) > 1 else nexts[0]
            nexts.remove(b)
            if not nexts:
                del onward[at]
            if b == start:
                break
            ring.append(b)
            at = b
        rings.append(np.array(ring))
    size = lambda r: abs(float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum()))
    ring = max(rings, key=size)
    a, c = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
    bent = np.abs((ring[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (ring[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) > 1e-6
    return ring[bent]


def union_area(boxes: np.ndarray) -> float:
    """Exact area of a union of boxes, by compressed coordinates."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    if not len(boxes):
        return 0.0
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    grid = np.zeros((len(ys), len(xs)), int)
    x1, x2 = np.searchsorted(xs, boxes[:, 0]), np.searchsorted(xs, boxes[:, 2])
    y1, y2 = np.searchsorted(ys, boxes[:, 1]), np.searchsorted(ys, boxes[:, 3])
    for x, y, sign in ((x1, y1, 1), (x2, y2, 1), (x1, y2, -1), (x2, y1, -1)):
        np.add.at(grid, (y, x), sign)
    covered = grid.cumsum(0).cumsum(1)[:-1, :-1] > 0
    return float((covered * np.outer(np.diff(ys), np.diff(xs))).sum())
