"""Column expressions: rounding, predicates, geometry and small linear algebra. All stay in the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def num(v: Num) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def round2(v: Column) -> Column:
    """Half away from zero at two decimals, on the double itself."""
    return F.signum(v) * F.floor(F.abs(v) * 100 + 0.5) / 100


def trunc(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")


def rounded(v: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(v + 0.5).cast("long")


# --- predicates


def inside_box(x: Column, y: Column, cx: Num, cy: Num, rx: Num, ry: Num | None = None) -> Column:
    """Open box."""
    cx, cy, rx = num(cx), num(cy), num(rx)
    ry = rx if ry is None else num(ry)
    return (x > cx - rx) & (x < cx + rx) & (y > cy - ry) & (y < cy + ry)


def in_limits(at: tuple, box: tuple, tol: float = 0.0) -> Column:
    """Whether a point (x, y) or (x, y, z) lies in the open box (least ..., greatest ...), the whole box moved up by ``tol``."""
    n = len(at)
    return reduce(Column.__and__, [(num(v) - num(box[k]) > tol) & (num(v) - num(box[n + k]) < tol) for k, v in enumerate(at)])


def inside_box3(x: Column, y: Column, z: Column, cx: Num, cy: Num, cz: Num, r: Num) -> Column:
    return inside_box(x, y, cx, cy, r) & (z > num(cz) - num(r)) & (z < num(cz) + num(r))


def box_overlap(a: tuple, b: tuple, tol: float = 0.0) -> Column:
    """Closed boxes (xmin, ymin, xmax, ymax) or (xmin, ymin, zmin, xmax, ymax, zmax): touching ones overlap.

    With ``tol`` b's upper sides must be that far above a's lower ones, and its lower ones may be that far above a's upper ones.
    """
    n = len(a) // 2
    if not tol:
        return reduce(Column.__and__, [(num(a[k]) <= num(b[n + k])) & (num(a[n + k]) >= num(b[k])) for k in range(n)])
    return reduce(Column.__and__, [(num(b[n + k]) - num(a[k]) >= tol) & (num(b[k]) - num(a[n + k]) <= tol) for k in range(n)])


def box_within(a: tuple, b: tuple, tol: float = 0.0) -> Column:
    """Box a within the closed box b, in two or three dimensions; with ``tol`` all sides of b count as that much higher."""
    n = len(a) // 2
    if not tol:
        return reduce(Column.__and__, [(num(a[k]) >= num(b[k])) & (num(a[n + k]) <= num(b[n + k])) for k in range(n)])
    return reduce(Column.__and__, [(num(a[n + k]) - num(b[n + k]) <= tol) & (num(a[k]) - num(b[k]) >= tol) for k in range(n)])


def distance2(ax: Num, ay: Num, bx: Num, by: Num) -> Column:
    dx, dy = num(ax) - num(bx), num(ay) - num(by)
    return dx * dx + dy * dy


def inside_circle(x: Column, y: Column, cx: Num, cy: Num, r: Num) -> Column:
    return distance2(x, y, cx, cy) < num(r) * num(r)


def box_mindist2(x: Column, y: Column, box: tuple, z: Column | None = None) -> Column:
    """Squared distance of a point to a box, 0 inside; with ``z`` the box has six sides (least ones first)."""
    at = [x, y] if z is None else [x, y, z]
    gaps = [F.greatest(num(box[k]) - v, v - num(box[len(at) + k]), F.lit(0.0)) for k, v in enumerate(at)]
    return reduce(Column.__add__, [g * g for g in gaps])


def box_minmaxdist2(x: Column, y: Column, box: tuple, z: Column | None = None) -> Column:
    """Least over the axes of the squared distance to the farthest corner of the nearer face; with ``z`` in three dimensions."""
    at = [x, y] if z is None else [x, y, z]
    sides = [(num(box[k]), num(box[len(at) + k])) for k in range(len(at))]
    near = [v - F.when(v <= (lo + hi) / 2, lo).otherwise(hi) for v, (lo, hi) in zip(at, sides, strict=True)]
    far = [v - F.when(v >= (lo + hi) / 2, lo).otherwise(hi) for v, (lo, hi) in zip(at, sides, strict=True)]
    return F.least(*[reduce(Column.__add__, [d * d for d in [near[k], *[far[i] for i in range(len(at)) if i != k]]]) for k in range(len(at))])


def on_range(v: Column, lo: Num, hi: Num) -> Column:
    return (v >= num(lo)) & (v <= num(hi))


def on_intensity(a: Column, b: Column, share: float) -> Column:
    """Whether two intensities differ by ``share`` of the larger at most."""
    return F.abs(a - b) <= F.greatest(a, b) * share


def differs_in_range(a: Column, b: Column, share: float) -> Column:
    """Whether two values differ by less than ``share`` of their mean."""
    return F.abs(a - b) < (a + b) / 2 * share


# --- lines and points


def point_line_distance(px: Num, py: Num, ax: Num, ay: Num, bx: Num, by: Num) -> Column:
    """Distance to the line through a and b; null if these are equal."""
    dx, dy = num(bx) - num(ax), num(by) - num(ay)
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size > 0, F.abs(dy * num(px) - dx * num(py) + num(bx) * num(ay) - num(by) * num(ax)) / size)


def line_coefficients(ax: Num, ay: Num, bx: Num, by: Num) -> tuple[Column, Column, Column]:
    """(A, B, C) of A x + B y = C."""
    a, b = num(by) - num(ay), num(ax) - num(bx)
    return a, b, a * num(ax) + b * num(ay)


def line_intersection(p: tuple, q: tuple) -> tuple[Column, Column]:
    """Where two lines, each given by two points, meet; null if parallel."""
    a1, b1, c1 = line_coefficients(*p)
    a2, b2, c2 = line_coefficients(*q)
    det = a1 * b2 - a2 * b1
    return F.when(det != 0, (b2 * c1 - b1 * c2) / det), F.when(det != 0, (a1 * c2 - a2 * c1) / det)


def nearest_on_line(px: Num, py: Num, ax: Num, ay: Num, bx: Num, by: Num) -> tuple[Column, Column]:
    """The foot of the perpendicular on the line through a and b."""
    dx, dy = num(bx) - num(ax), num(by) - num(ay)
    t = ((num(px) - num(ax)) * dx + (num(py) - num(ay)) * dy) / (dx * dx + dy * dy)
    return num(ax) + t * dx, num(ay) + t * dy


def midpoint(ax: Num, ay: Num, bx: Num, by: Num) -> tuple[Column, Column]:
    return (num(ax) + num(bx)) / 2, (num(ay) + num(by)) / 2


def rotate(x: Num, y: Num, angle: float) -> tuple[Column, Column]:
    c, s = math.cos(angle), math.sin(angle)
    return num(x) * c - num(y) * s, num(x) * s + num(y) * c


def moved(x: Num, y: Num, dx: Num, dy: Num, length: Num) -> tuple[Column, Column]:
    """``length`` along the direction (dx, dy)."""
    size = F.sqrt(num(dx) * num(dx) + num(dy) * num(dy))
    return num(x) + num(dx) / size * num(length), num(y) + num(dy) / size * num(length)


def to_origin(at: tuple, origin: tuple) -> tuple[Column, ...]:
    """A point's coordinates from ``origin``."""
    return tuple(num(a) - num(o) for a, o in zip(at, origin, strict=True))


def polar_pair(cx: Num, cy: Num, distance: Num, angle: float, side: float = 1.0) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The points ``side`` to the left and to the right of the end of a ray."""
    c, s = math.cos(angle), math.sin(angle)
    x, y = num(cx) + num(distance) * c, num(cy) + num(distance) * s
    return (x - side * s, y + side * c), (x + side * s, y - side * c)


def segment_ends(cx: Num, cy: Num, dx: Num, dy: Num, half: Num) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The ends of a segment about its centre, ``half`` each way along a direction."""
    return moved(cx, cy, dx, dy, half), moved(cx, cy, -num(dx), -num(dy), half)


# --- vectors


def added(a: tuple, b: tuple) -> tuple[Column, ...]:
    return tuple(num(u) + num(v) for u, v in zip(a, b, strict=True))


def subtracted(a: tuple, b: tuple) -> tuple[Column, ...]:
    return tuple(num(u) - num(v) for u, v in zip(a, b, strict=True))


def scaled_by(a: tuple, factor: Num) -> tuple[Column, ...]:
    return tuple(num(v) * num(factor) for v in a)


def perpendicular(a: tuple) -> tuple[Column, Column]:
    """A quarter turn to the left in the plane."""
    return -num(a[1]), num(a[0])


def dot(a: tuple, b: tuple) -> Column:
    out = num(a[0]) * num(b[0])
    for u, v in zip(a[1:], b[1:], strict=True):
        out = out + num(u) * num(v)
    return out


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return (num(a[1]) * num(b[2]) - num(a[2]) * num(b[1]), num(a[2]) * num(b[0]) - num(a[0]) * num(b[2]), num(a[0]) * num(b[1]) - num(a[1]) * num(b[0]))


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: tuple) -> tuple[Column, ...]:
    """Null for a vector without length."""
    size = norm(a)
    return tuple(F.when(size > 0, num(v) / size) for v in a)


def angle2(x: Num, y: Num, turn: str = "plain") -> Column:
    """atan2(y, x); below zero ``half`` adds pi and ``full`` two pi."""
    a = F.atan2(num(y), num(x))
    more = {"plain": 0.0, "half": math.pi, "full": 2 * math.pi}[turn]
    return F.when(a < 0, a + more).otherwise(a)


def axis_angles(a: tuple) -> tuple[Column, ...]:
    """Degrees between a vector and each axis."""
    size = norm(a)
    return tuple(F.degrees(F.acos(num(v) / size)) for v in a)


def on_degree(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two directions in degrees differ by ``tolerance`` at most, around the circle."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d) <= tolerance


def number(v: Column) -> Column:
    """Null for what is not a finite number."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


# --- polygons, as arrays of struct<x, y>


def shoelace2(ring: Column) -> Column:
    """Twice the signed area of a ring."""
    n = F.size(ring)
    def term(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        return a["x"] * b["y"] - b["x"] * a["y"]
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + term(i))


def perimeter(ring: Column) -> Column:
    n = F.size(ring)
    def side(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + side(i))


def centroid(ring: Column) -> tuple[Column, Column]:
    n, area2 = F.size(ring), shoelace2(ring)
    def part(axis: str) -> Column:
        def term(i: Column) -> Column:
            a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
            return (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"])
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + term(i)) / (area2 * 3)
    return part("x"), part("y")


def ccw(ax: Num, ay: Num, bx: Num, by: Num, cx: Num, cy: Num) -> Column:
    """Twice the signed area of a triangle: above zero if it turns left."""
    return (num(bx) - num(ax)) * (num(cy) - num(ay)) - (num(by) - num(ay)) * (num(cx) - num(ax))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a literal ring."""
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ay == by:
            continue
        crosses = ((F.lit(float(ay)) > y) != (F.lit(float(by)) > y)) & (x < (y - float(ay)) * ((bx - ax) / (by - ay)) + float(ax))
        odd = odd != crosses
    return odd


def in_hull(x: Column, y: Column, ring: list[tuple[float, float]], turn: int = 1) -> Column:
    """Whether a point is on no outer side of the edges of a literal hull; ``turn`` -1 for a clockwise one. The closing edge is not tested."""
    out = F.lit(True)
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        out = out & (ccw(ax, ay, bx, by, x, y) * turn >= 0)
    return out


def plane_patch(p: tuple, q: tuple, normal: tuple, half: float = 7.5) -> list[tuple[Column, Column, Column]]:
    """Four corners, ``half`` each way, about p in the plane that holds the horizontal direction from p to q and is square to ``normal``."""
    dx, dy = num(q[0]) - num(p[0]), num(q[1]) - num(p[1])
    size = F.sqrt(dx * dx + dy * dy)
    tan = (dx / size, dy / size, (num(q[2]) - num(p[2])) / size)
    side = cross(tan, normal)
    return [tuple(num(c) + (u * a + v * b) * half for c, u, v in zip(p, tan, side, strict=True)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


# --- planes and symmetric matrices


def solve2(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """(u, v) of a u + b v = e, c u + d v = f; null if singular."""
    det = a * d - b * c
    return F.when(det != 0, (e * d - b * f) / det), F.when(det != 0, (a * f - e * c) / det)


def det3(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def solve3(m: list[list[Column]], v: list[Column]) -> tuple[Column, Column, Column]:
    """Cramer's rule; null if singular."""
    det = det3(m)
    return tuple(F.when(det != 0, det3([[v[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]) / det) for k in range(3))


def plane_distance(x: Num, y: Num, z: Num, a: Num, b: Num, c: Num) -> Column:
    """Distance of a point to the plane z = a x + b y + c."""
    return F.abs(num(a) * num(x) + num(b) * num(y) - num(z) + num(c)) / F.sqrt(num(a) * num(a) + num(b) * num(b) + 1)


def plane_normal(a: Num, b: Num) -> tuple[Column, Column, Column]:
    """Upward unit normal of z = a x + b y + c."""
    size = F.sqrt(num(a) * num(a) + num(b) * num(b) + 1)
    return -num(a) / size, -num(b) / size, 1 / size


def eigenvalues3(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric matrix, largest first, by the trigonometric form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    b = [[(xx - q) / p, xy / p, xz / p], [xy / p, (yy - q) / p, yz / p], [xz / p, yz / p, (zz - q) / p]]
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det3(b) / 2))) / 3
    one = F.when(p == 0, q).otherwise(q + 2 * p * F.cos(phi))
    three = F.when(p == 0, q).otherwise(q + 2 * p * F.cos(phi + 2 * math.pi / 3))
    return one, 3 * q - one - three, three
