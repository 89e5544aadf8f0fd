"""Kernels of the cell layout over arrays: descent of the split tree, and search inside a cell.

Points and corners are rows of arrays, whole numbers or doubles throughout. A tree is at
most 2 * 2**16 nodes, so a task holds it; a cell is cut into buckets of a few points, whose
boxes prune again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BUCKET = 64
CHUNK = 256
REGIONS = 4096
PAIRS = 8192
TILE = 4


@dataclass
class Split:
    """Left is below ``at`` on dimension ``dim``, right at or above it; a leaf has neither."""

    dim: int = -1
    at: float = 0
    left: Split | None = None
    right: Split | None = None


def split_sample(rows, dim: int, levels: int, rule: str | tuple = "widest", level: int = 0) -> Split:
    """Splits at upper medians of the widest dimension, of each in turn (``rotate``), or of the widest in units of ``rule`` (a width for each)."""
    x = rows if isinstance(rows, np.ndarray) else np.array([tuple(r) for r in rows]).reshape(-1, dim)
    if level == levels or len(x) < 2:
        return Split()
    extents = x.max(axis=0) - x.min(axis=0)
    if not isinstance(rule, str):
        extents = extents / np.array(rule, dtype=float)
    d = level % dim if rule == "rotate" else int(extents.argmax())
    values = np.sort(x[:, d])
    at = values[len(values) // 2]
    if at == values[0]:  # all of the lower half are equal: split above them
        above = values[values > at]
        if not len(above):
            return Split()
        at = above[0]
    right = x[:, d] >= at
    return Split(d, at.item(), split_sample(x[~right], dim, levels, rule, level + 1), split_sample(x[right], dim, levels, rule, level + 1))


def square_sum(parts: np.ndarray) -> np.ndarray:
    """Sum of squares over the last axis; whole numbers that leave 64 bits are an error."""
    if parts.dtype.kind == "i" and parts.size and float(np.abs(parts.astype(float)).max()) ** 2 * parts.shape[-1] >= 2.0**63:
        raise ArithmeticError("[ARITHMETIC_OVERFLOW] a squared distance exceeds 64 bits")
    out = parts[..., 0] * parts[..., 0]
    for k in range(1, parts.shape[-1]):
        out = out + parts[..., k] * parts[..., k]
    return out


def _all(tests: np.ndarray) -> np.ndarray:
    """``tests.all(axis=-1)`` for a short axis."""
    out = tests[..., 0]
    for k in range(1, tests.shape[-1]):
        out = out & tests[..., k]
    return out


def dist2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return square_sum(p - q)


def min_dist2(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return square_sum(np.maximum(np.maximum(lo - q, q - hi), 0))


def max_dist2(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return square_sum(np.maximum(np.abs(q - lo), np.abs(hi - q)))


class Tree:
    """The splits as arrays, with the count and box of what lies under each node."""

    def __init__(self, split: Split, dim: int, cells: dict[int, tuple], kind: str):
        self.dim, self.kind = dim, kind
        nodes: list[tuple[Split, int]] = [(split, 1)]
        self.left: list[int] = []
        for s, number in nodes:  # grows while it is read
            self.left.append(len(nodes) if s.left is not None else -1)
            if s.left is not None:
                nodes += [(s.left, 2 * number), (s.right, 2 * number + 1)]
        self.left = np.array(self.left)
        self.number = np.array([n for _, n in nodes], dtype=np.int64)
        self.turn = np.array([max(s.dim, 0) for s, _ in nodes])
        whole = kind == "int64" and all(float(s.at).is_integer() for s, _ in nodes)
        self.at = np.array([s.at for s, _ in nodes], dtype="int64" if whole else "float64")
        self.count = np.zeros(len(nodes), dtype=np.int64)
        self.lo, self.hi = np.zeros((len(nodes), dim), dtype=kind), np.zeros((len(nodes), dim), dtype=kind)
        for k in range(len(nodes) - 1, -1, -1):
            if self.left[k] < 0:
                if int(self.number[k]) in cells:
                    self.count[k], self.lo[k], self.hi[k] = cells[int(self.number[k])]
                continue
            below = [c for c in (self.left[k], self.left[k] + 1) if self.count[c] > 0]
            if below:
                self.count[k], self.lo[k], self.hi[k] = self.count[below].sum(), self.lo[below].min(axis=0), self.hi[below].max(axis=0)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        """The number of the leaf of each point."""
        node = np.zeros(len(x), dtype=np.int64)
        moving = np.flatnonzero(self.left[node] >= 0)
        while len(moving):
            here = node[moving]
            node[moving] = self.left[here] + (x[moving, self.turn[here]] >= self.at[here])
            moving = moving[self.left[node[moving]] >= 0]
        return self.number[node]

    def touched(self, n: int, meets: Callable, inside: Callable | None) -> tuple[np.ndarray, ...]:
        """(region, node) that lie inside and (region, leaf) that are cut, by tests on (regions, nodes)."""
        region, node = np.arange(n), np.zeros(n, dtype=np.int64)
        whole, cut = [], []
        while len(region):
            keep = self.count[node] > 0
            region, node = region[keep], node[keep]
            keep = meets(region, node)
            region, node = region[keep], node[keep]
            if inside is not None:
                full = inside(region, node)
                whole.append((region[full], node[full]))
                region, node = region[~full], node[~full]
            leaf = self.left[node] < 0
            cut.append((region[leaf], node[leaf]))
            region, node = np.repeat(region[~leaf], 2), np.repeat(self.left[node[~leaf]], 2)
            node[1::2] += 1
        join = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        return join(whole, 0), join(whole, 1), join(cut, 0), join(cut, 1)


class Boxes:
    """Tests of regions (lo, hi) against boxes and points, by pairs of row numbers."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi

    def __len__(self) -> int:
        return len(self.lo)

    def meets(self, r, lo, hi):
        return _all((lo <= self.hi[r]) & (self.lo[r] <= hi))

    def widths(self) -> np.ndarray | None:
        """To cut points by, so that few runs are cut by a box."""
        mean = (self.hi.astype(float) - self.lo.astype(float)).mean(axis=0)
        return mean if (mean > 0).all() and np.isfinite(mean).all() else None

    def meets_open(self, r, lo, hi):
        return _all((lo < self.hi[r]) & (self.lo[r] < hi))

    def inside(self, r, lo, hi):
        return _all((lo >= self.lo[r]) & (hi <= self.hi[r]))

    def holds(self, r, p):
        return _all((p >= self.lo[r]) & (p <= self.hi[r]))


class OpenBoxes(Boxes):
    """Boxes without their sides."""

    def meets(self, r, lo, hi):
        return self.meets_open(r, lo, hi)

    def inside(self, r, lo, hi):
        return _all((lo > self.lo[r]) & (hi < self.hi[r]))

    def holds(self, r, p):
        return _all((p > self.lo[r]) & (p < self.hi[r]))


class Balls:
    def __init__(self, centre: np.ndarray, radius: np.ndarray):
        self.centre, self.far = centre, square_sum(radius[:, None])

    def widths(self) -> None:
        """Equal on all dimensions."""

    def __len__(self) -> int:
        return len(self.centre)

    def meets(self, r, lo, hi):
        return min_dist2(self.centre[r], lo, hi) <= self.far[r]

    def inside(self, r, lo, hi):
        return max_dist2(self.centre[r], lo, hi) <= self.far[r]

    def holds(self, r, p):
        return dist2(p, self.centre[r]) <= self.far[r]


def weight_in_boxes(points: np.ndarray, weight: np.ndarray, boxes: Boxes) -> np.ndarray:
    """The weight of the points in each box.

    Boxes are taken together by the dimensions on which they don't cover all points. None
    of these: the whole weight; one: a difference of running sums; two: a wavelet matrix,
    so a box costs some lookups for each bit of a rank; more: buckets.
    """
    out = np.zeros(len(boxes), dtype=np.int64)
    cuts = (boxes.lo > points.min(axis=0)) | (boxes.hi < points.max(axis=0))
    for kind in np.unique(cuts, axis=0):
        at, dims = np.flatnonzero((cuts == kind).all(axis=1)), np.flatnonzero(kind)
        lo, hi = boxes.lo[at], boxes.hi[at]
        if not len(dims):
            out[at] = weight.sum()
        elif len(dims) == 1:
            first, last, _, sums = _run(points[:, dims[0]], weight, lo[:, dims[0]], hi[:, dims[0]])
            out[at] = sums[last] - sums[first]
        elif len(dims) == 2:
            out[at] = _in_plane(points[:, dims], weight, lo[:, dims], hi[:, dims])
        else:
            out[at] = Buckets(points).counts(Boxes(lo, hi), weight)
    return out


def _run(values: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last place of each interval in the order of values, that order, and its running weights."""
    order = np.argsort(values, kind="stable")
    first, last = np.searchsorted(values[order], lo, "left"), np.searchsorted(values[order], hi, "right")
    return first, np.maximum(first, last), order, np.concatenate([[0], np.cumsum(weight[order])])


def _in_plane(points: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    first, last, order, _ = _run(points[:, 0], weight, lo[:, 0], hi[:, 0])
    values, rank = np.unique(points[:, 1], return_inverse=True)
    rank, weight = rank.reshape(-1)[order], weight[order]
    low, high = np.searchsorted(values, lo[:, 1], "left"), np.searchsorted(values, hi[:, 1], "right")
    a, b, below = np.tile(first, 2), np.tile(last, 2), np.concatenate([low, np.maximum(low, high)])
    out = np.zeros(len(below), dtype=np.int64)  # weight of the ranks below, in places a to b
    for bit in range(len(values).bit_length() - 1, -1, -1):
        zero = (rank >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        rank, weight = np.concatenate([rank[zero], rank[~zero]]), np.concatenate([weight[zero], weight[~zero]])
        sums = np.concatenate([[0], np.cumsum(weight)])
        za, zb, up = before[a], before[b], (below >> bit) & 1 == 1
        out += np.where(up, sums[zb] - sums[za], 0)
        a, b = np.where(up, before[-1] + a - za, za), np.where(up, before[-1] + b - zb, zb)
    return out[len(low) :] - out[: len(low)]


class Buckets:
    """A cell's points in runs of ``BUCKET``, the last of fewer, cut near medians of the widest dimension (in units of ``widths``, if given); in a run they keep their order."""

    def __init__(self, points: np.ndarray, widths: np.ndarray | None = None):
        order, runs, open_ = np.arange(len(points)), [], [(0, len(points))]
        while open_:
            a, b = open_.pop()
            if b - a <= BUCKET:
                if b > a:
                    order[a:b].sort()
                    runs.append((a, b))
                continue
            x = points[order[a:b]]
            extents = x.max(axis=0) - x.min(axis=0)
            d, half = int((extents if widths is None else extents / widths).argmax()), -(-(b - a) // (2 * BUCKET)) * BUCKET
            order[a:b] = order[a:b][np.argpartition(x[:, d], half)]
            open_ += [(a + half, b), (a, a + half)]
        self.order, self.points = order, points[order]
        self.start, self.stop = (np.array([r[k] for r in runs], dtype=np.int64) for k in (0, 1))
        self.count = self.stop - self.start
        self.lo, self.hi = (np.array([f(self.points[a:b], axis=0) for a, b in runs]).reshape(-1, points.shape[1]) for f in (np.min, np.max))

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """The places of all points of the buckets."""
        n = self.count[buckets]
        if (n == BUCKET).all():
            return (self.start[buckets][:, None] + np.arange(BUCKET)).reshape(-1)
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[buckets] - (ends - n), n)

    def pairs(self, regions, chunk: np.ndarray, buckets: np.ndarray | None = None):
        """(region, bucket, lies inside) of what meets, in blocks; of all buckets or of some."""
        buckets = np.arange(len(self.count)) if buckets is None else buckets
        r, b = np.repeat(chunk, len(buckets)), np.tile(buckets, len(chunk))
        met = regions.meets(r, self.lo[b], self.hi[b])
        r, b = r[met], b[met]
        for i in range(0, len(r), PAIRS):
            part = slice(i, i + PAIRS)
            yield r[part], b[part], regions.inside(r[part], self.lo[b[part]], self.hi[b[part]])

    def found(self, regions, r: np.ndarray, b: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(region, place) of the points of pairs that a region holds."""
        place, region = self.rows(b), np.repeat(r, self.count[b])
        if full.all():
            return region, place
        sure = np.repeat(full, self.count[b])
        unsure = np.flatnonzero(~sure)
        sure[unsure] = regions.holds(region[unsure], self.points[place[unsure]])
        return region[sure], place[sure]

    def counts(self, regions, weight: np.ndarray) -> np.ndarray:
        """The weight of the points in each region."""
        weight, out = weight[self.order], np.zeros(len(regions), dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(weight)])
        whole = sums[self.stop] - sums[self.start]
        for i in range(0, len(regions), CHUNK):
            for r, b, full in self.pairs(regions, np.arange(i, min(i + CHUNK, len(regions)))):
                np.add.at(out, r[full], whole[b[full]])
                hit, place = self.found(regions, r[~full], b[~full], full[~full])
                np.add.at(out, hit, weight[place])
        return out

    def reports(self, regions):
        """(region, place in the order of buckets) of what the regions hold, in parts.

        A few buckets at a time for all of a chunk: what regions that follow each other find
        there is alike, so columns of the places repeat within what a file's compression looks back on.
        """
        for i in range(0, len(regions), CHUNK):
            chunk = np.arange(i, min(i + CHUNK, len(regions)))
            for t in range(0, len(self.count), TILE):
                for r, b, full in self.pairs(regions, chunk, np.arange(t, min(t + TILE, len(self.count)))):
                    hit, place = self.found(regions, r, b, full)
                    if len(hit):
                        yield hit, place

    def nearest(self, ids: np.ndarray, q: np.ndarray, qid: np.ndarray | None, k: int, bound: np.ndarray | None):
        """(query, row of the cell, squared distance) of the k nearest within the bound, by distance and id.

        ``qid``: ids that a query doesn't meet. Queries are taken together by their nearest
        bucket; only buckets that one of them can need are compared.
        """
        need = k + (qid is not None)
        reach = min(need, int(self.count.sum()))
        nearest = np.concatenate([min_dist2(q[i : i + CHUNK, None], self.lo, self.hi).argmin(axis=1) for i in range(0, len(q), CHUNK)])
        turn = np.argsort(nearest, kind="stable")
        for i in range(0, len(q), CHUNK):
            at = turn[i : i + CHUNK]
            x = q[at]
            low, far = min_dist2(x[:, None], self.lo, self.hi), max_dist2(x[:, None], self.lo, self.hi)
            order = np.argsort(far, axis=1, kind="stable")
            enough = (np.cumsum(self.count[order], axis=1) >= reach).argmax(axis=1)
            upto = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
            if bound is not None:
                upto = np.minimum(upto, bound[at])
            place = self.rows(np.flatnonzero((low <= upto[:, None]).any(axis=0)))
            if not len(place):
                continue
            rows = self.order[place]
            step = max(1, 4_000_000 // len(place))
            for s in range(0, len(at), step):
                mine = at[s : s + step]
                d = dist2(q[mine][:, None], self.points[place][None])
                other = np.ones(d.shape, dtype=bool) if qid is None else ids[rows][None] != qid[mine][:, None]
                edge = np.partition(d, min(need, len(place)) - 1, axis=1)[:, min(need, len(place)) - 1]
                edge = np.minimum(edge, upto[s : s + step])
                row, col = np.nonzero((d <= edge[:, None]) & other)
                value = d[row, col]
                best = np.lexsort((ids[rows[col]], value, row))
                row, col, value = row[best], col[best], value[best]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                yield mine[row[keep]], rows[col[keep]], value[keep]
