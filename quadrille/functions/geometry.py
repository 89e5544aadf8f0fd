"""Column expressions over points, boxes and balls of any dimension.

A point is a list of columns, a box two lists (low and high corner, both closed), a ball
a point and a radius. Distances are squared and are never rooted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def coords(dim: int, prefix: str = "c", of: str | None = None) -> list[Column]:
    """Columns ``c0 .. c{dim-1}``, of a named frame if given."""
    return [F.col(f"{of}.{prefix}{i}" if of else f"{prefix}{i}") for i in range(dim)]


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def square(x: Column) -> Column:
    return x * x


# ---- boxes


def point_in_box(p: Point, lo: Point, hi: Point) -> Column:
    return all_of([c.between(a, b) for c, a, b in zip(p, lo, hi)])


def box_in_box(lo: Point, hi: Point, outer_lo: Point, outer_hi: Point) -> Column:
    return all_of([(a >= oa) & (b <= ob) for a, b, oa, ob in zip(lo, hi, outer_lo, outer_hi)])


def box_meets_box(lo: Point, hi: Point, other_lo: Point, other_hi: Point) -> Column:
    """Touching counts."""
    return all_of([(a <= ob) & (oa <= b) for a, b, oa, ob in zip(lo, hi, other_lo, other_hi)])


def point_in_widened_box(p: Point, lo: Point, hi: Point, epsilon: float) -> Column:
    """Strictly inside the box made wider by ``epsilon`` on all sides; narrower if it is negative."""
    return all_of([(c > a - F.lit(epsilon)) & (c < b + F.lit(epsilon)) for c, a, b in zip(p, lo, hi)])


def same_point(p: Point, q: Point) -> Column:
    return all_of([a == b for a, b in zip(p, q)])


def same_box(lo: Point, hi: Point, other_lo: Point, other_hi: Point) -> Column:
    return same_point(lo, other_lo) & same_point(hi, other_hi)


def legal_box(lo: Point, hi: Point) -> Column:
    """Low corner below the high one in every dimension, or empty (all null)."""
    return all_of([a <= b for a, b in zip(lo, hi)]) | all_of([x.isNull() for x in [*lo, *hi]])


def merged_box(lo: Point, hi: Point, other_lo: Point, other_hi: Point) -> tuple[list[Column], list[Column]]:
    """The hull. ``least`` and ``greatest`` skip nulls, so the empty box is the identity."""
    return [F.least(a, b) for a, b in zip(lo, other_lo)], [F.greatest(a, b) for a, b in zip(hi, other_hi)]


def widest_dimension(lo: Point, hi: Point) -> Column:
    """From 0; of equal extents the first."""
    extents = F.array(*[b - a for a, b in zip(lo, hi)])
    return F.array_position(extents, F.array_max(extents)) - 1


# ---- distances


def dist2(p: Point, q: Point) -> Column:
    return total([square(a - b) for a, b in zip(p, q)])


def min_dist2(p: Point, lo: Point, hi: Point) -> Column:
    """To the nearest point of a box; 0 inside."""
    return total([square(F.greatest(a - c, c - b, (c - c))) for c, a, b in zip(p, lo, hi)])


def max_dist2(p: Point, lo: Point, hi: Point) -> Column:
    """To the farthest corner of a box."""
    return total([square(F.greatest(F.abs(c - a), F.abs(b - c))) for c, a, b in zip(p, lo, hi)])


def array_dist2(a: Column, b: Column) -> Column:
    """Between arrays of doubles, summed in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: square(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


# ---- balls


def point_in_ball(p: Point, centre: Point, radius: Column) -> Column:
    return dist2(p, centre) <= square(radius)


def box_in_ball(lo: Point, hi: Point, centre: Point, radius: Column) -> Column:
    return max_dist2(centre, lo, hi) <= square(radius)


def ball_meets_box(lo: Point, hi: Point, centre: Point, radius: Column) -> Column:
    return min_dist2(centre, lo, hi) <= square(radius)


# ---- order keys


def quantised(p: Point, lo: Point, extent: Column, bits: int) -> list[Column]:
    """Each coordinate as an integer below 2**bits, relative to the largest extent."""
    top = (1 << bits) - 1
    return [F.least(F.floor((c - a).cast("double") / F.greatest(extent.cast("double"), F.lit(1e-300)) * top), F.lit(top)).cast("long") for c, a in zip(p, lo)]


def morton_key(p: Point, bits: int) -> Column:
    """Interleaved bits of integers below 2**bits, lowest first, dimension 0 lowest; 63 bits at most."""
    dim = len(p)
    if bits * dim > 63:
        raise ValueError("a signed long holds 63 bits")
    parts = [F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)), b * dim + i) for b in range(bits) for i, c in enumerate(p)]
    return reduce(lambda x, y: x.bitwiseOR(y), parts)


def bit_is_low(key: Column, position: int) -> Column:
    """1 if the key's low ``position`` bits are at most 2**(position-1), else 0."""
    return (key.bitwiseAND(F.lit((1 << position) - 1)) <= F.lit(1 << (position - 1))).cast("int")


def imbalanced(left: Column, n: Column, ratio: int = 30) -> Column:
    """Whether the left share of n is off one half by more than ``ratio`` percent; empty counts."""
    return F.when(n == 0, True).otherwise(F.floor(F.abs(100.0 * left / n - 50.0)) > ratio)


# ---- plane and space


def added(p: Point, q: Point) -> list[Column]:
    return [a + b for a, b in zip(p, q)]


def subtracted(p: Point, q: Point) -> list[Column]:
    return [a - b for a, b in zip(p, q)]


def scaled(p: Point, by: Column) -> list[Column]:
    return [a * by for a in p]


def dot(p: Point, q: Point) -> Column:
    return total([a * b for a, b in zip(p, q)])


def length(p: Point) -> Column:
    return F.sqrt(dot(p, p))


def cross(p: Point, q: Point) -> Column | list[Column]:
    if len(p) == 2:
        return p[0] * q[1] - p[1] * q[0]
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def triangle_area2(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area; positive if counter-clockwise."""
    return cross(subtracted(b, a), subtracted(c, a))


def counter_clockwise(a: Point, b: Point, c: Point) -> Column:
    return triangle_area2(a, b, c) > 0


def in_circle(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Whether d lies inside the circle through a, b, c (counter-clockwise)."""
    rows = [(*subtracted(p, d), dist2(p, d)) for p in (a, b, c)]
    (ax, ay, al), (bx, by, bl), (cx, cy, cl) = rows
    return ax * (by * cl - cy * bl) - ay * (bx * cl - cx * bl) + al * (bx * cy - cx * by) > 0


def angle(a: Point, b: Point, c: Point) -> Column:
    """At a, in degrees."""
    u, v = subtracted(b, a), subtracted(c, a)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (length(u) * length(v))))))


def min_angle(a: Point, b: Point, c: Point) -> Column:
    return F.least(angle(a, b, c), angle(b, c, a), angle(c, a, b))


def circumcentre(a: Point, b: Point, c: Point) -> list[Column]:
    (bx, by), (cx, cy) = subtracted(b, a), subtracted(c, a)
    twice, b2, c2 = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    return [a[0] + (cy * b2 - by * c2) / twice, a[1] + (bx * c2 - cx * b2) / twice]


def orthant(p: Point, centre: Point) -> Column:
    """Bit i set if coordinate i lies at or beyond the centre's."""
    return total([F.when(c >= m, 1 << i).otherwise(0) for i, (c, m) in enumerate(zip(p, centre))])


def outside_cube(p: Point, centre: Point, half: Column) -> Column:
    return ~all_of([F.abs(c - m) <= half for c, m in zip(p, centre)])
