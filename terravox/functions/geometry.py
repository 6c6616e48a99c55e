"""Measures and predicates over points, lines, rays, spans, planes, boxes, spheres, cylinders and triangles.

A plane is (normal, d): normal . p + d = 0 with a unit normal. A line is (point, unit vector), a ray the same with
t >= 0, a span two end points, a box two corners. All functions take and give Columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..constants import EPSILON, INFINITY
from .vec import V2, V3, col

Plane = tuple[V3, F.Column]


def clamp(x: F.Column, low, high) -> F.Column:
    return F.least(F.greatest(x, col(low)), col(high))


# scalars with tolerance
def is_zero(x: F.Column, eps: float = EPSILON) -> F.Column:
    return F.abs(x) <= eps


def is_equal(a: F.Column, b: F.Column, eps: float = EPSILON) -> F.Column:
    return F.abs(a - b) <= eps


def is_positive(x: F.Column, eps: float = EPSILON) -> F.Column:
    return x > eps


def is_negative(x: F.Column, eps: float = EPSILON) -> F.Column:
    return x < -eps


def is_less(a: F.Column, b: F.Column, eps: float = EPSILON) -> F.Column:
    return b - a > eps


def is_greater(a: F.Column, b: F.Column, eps: float = EPSILON) -> F.Column:
    return a - b > eps


# distances
def point_point(a: V3, b: V3) -> F.Column:
    return a.minus(b).norm()


def point_line(p: V3, on: V3, along: V3) -> F.Column:
    return p.minus(on).cross(along).norm()


def point_ray(p: V3, start: V3, along: V3) -> F.Column:
    t = p.minus(start).dot(along)
    return F.when(t <= 0, point_point(p, start)).otherwise(point_line(p, start, along))


def closest_on_span(p: V3, a: V3, b: V3) -> V3:
    d = b.minus(a)
    t = clamp(F.coalesce(F.try_divide(p.minus(a).dot(d), d.squared()), F.lit(0.0)), 0, 1)
    return a.plus(d.times(t))


def point_span(p: V3, a: V3, b: V3) -> F.Column:
    return point_point(p, closest_on_span(p, a, b))


def point_plane_signed(p: V3, plane: Plane) -> F.Column:
    return plane[0].dot(p) + plane[1]


def point_plane(p: V3, plane: Plane) -> F.Column:
    return F.abs(point_plane_signed(p, plane))


def plane_through(p: V3, normal: V3) -> Plane:
    return normal, -normal.dot(p)


def closest_in_box(p: V3, low: V3, high: V3) -> V3:
    return V3(*(clamp(c, a, b) for c, a, b in zip(p, low, high, strict=True)))


def furthest_in_box(p: V3, low: V3, high: V3) -> V3:
    return V3(*(F.when(c > (a + b) / 2, a).otherwise(b) for c, a, b in zip(p, low, high, strict=True)))


def point_box(p: V3, low: V3, high: V3) -> F.Column:
    return point_point(p, closest_in_box(p, low, high))


def point_box_xy(p: V3, low: V3, high: V3) -> F.Column:
    q = closest_in_box(p, low, high)
    return V2(p.x - q.x, p.y - q.y).norm()


def box_box(low1: V3, high1: V3, low2: V3, high2: V3) -> F.Column:
    gap = [F.greatest(a2 - b1, a1 - b2, F.lit(0.0)) for a1, b1, a2, b2 in zip(low1, high1, low2, high2, strict=True)]
    return V3(*gap).norm()


def point_sphere(p: V3, center: V3, radius) -> F.Column:
    return F.greatest(point_point(p, center) - col(radius), F.lit(0.0))


def line_line(p: V3, u: V3, q: V3, v: V3) -> F.Column:
    n = u.cross(v)
    return F.when(n.norm() > EPSILON, F.abs(F.try_divide(q.minus(p).dot(n), n.norm()))).otherwise(point_line(q, p, u))


def closest_on_triangle(p: V3, a: V3, b: V3, c: V3) -> V3:
    """Inside: the foot in the plane; else the closest of the three sides."""
    n = b.minus(a).cross(c.minus(a)).unit()
    foot = p.minus(n.times(p.minus(a).dot(n)))
    inside = (b.minus(a).cross(foot.minus(a)).dot(n) >= 0) & (c.minus(b).cross(foot.minus(b)).dot(n) >= 0) & (a.minus(c).cross(foot.minus(c)).dot(n) >= 0) & (n.squared() > 0)
    sides = [closest_on_span(p, s, e) for s, e in ((a, b), (b, c), (c, a))]
    d = [p.minus(s).squared() for s in sides]
    pick = lambda k: F.when(inside, foot[k]).when((d[0] <= d[1]) & (d[0] <= d[2]), sides[0][k]).when(d[1] <= d[2], sides[1][k]).otherwise(sides[2][k])
    return V3(pick(0), pick(1), pick(2))


# containment
def in_box(p: V3, low: V3, high: V3, eps: float = 0.0) -> F.Column:
    return reduce(lambda a, b: a & b, (c.between(lo - eps, hi + eps) for c, lo, hi in zip(p, low, high, strict=True)))


def in_oriented_box(p: V3, center: V3, axes: tuple[V3, V3, V3], radii: tuple) -> F.Column:
    d = p.minus(center)
    return reduce(lambda a, b: a & b, (F.abs(d.dot(axis)) <= r for axis, r in zip(axes, radii, strict=True)))


def in_sphere(p: V3, center: V3, radius) -> F.Column:
    return p.minus(center).squared() <= col(radius) * col(radius)


def in_cylinder(p: V3, center: V3, radius, low, high) -> F.Column:
    """A vertical cylinder."""
    d = p.minus(center)
    return (d.x * d.x + d.y * d.y <= col(radius) * col(radius)) & p.z.between(col(low), col(high))


def in_halfspace(p: V3, plane: Plane) -> F.Column:
    return point_plane_signed(p, plane) >= 0


def in_circle2(p: V2, center: V2, radius) -> F.Column:
    d = p.minus(center)
    return d.dot(d) <= col(radius) * col(radius)


def in_polygon2(p: V2, corners: list[tuple[float, float]]) -> F.Column:
    """Even-odd rule."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        straddles = (F.lit(y1) > p.y) != (F.lit(y2) > p.y)
        crossed = crossed + (straddles & (p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1)).cast("int")
    return crossed % 2 == 1


# intersection
def boxes_meet(low1: V3, high1: V3, low2: V3, high2: V3) -> F.Column:
    return reduce(lambda a, b: a & b, ((a1 <= b2) & (a2 <= b1) for a1, b1, a2, b2 in zip(low1, high1, low2, high2, strict=True)))


def boxes_abut(low1: V3, high1: V3, low2: V3, high2: V3, eps: float = EPSILON) -> F.Column:
    """They touch without sharing volume."""
    touch = reduce(lambda a, b: a | b, ((F.abs(a1 - b2) <= eps) | (F.abs(a2 - b1) <= eps) for a1, b1, a2, b2 in zip(low1, high1, low2, high2, strict=True)))
    return touch & boxes_meet(*(V3(*(c + s * eps for c in v)) for v, s in zip((low1, high1, low2, high2), (-1, 1, -1, 1), strict=True)))


def spheres_meet(c1: V3, r1, c2: V3, r2) -> F.Column:
    return c1.minus(c2).squared() <= (col(r1) + col(r2)) * (col(r1) + col(r2))


def ray_plane(start: V3, along: V3, plane: Plane) -> F.Column:
    """t of the hit, null if there is none."""
    t = F.try_divide(-point_plane_signed(start, plane), plane[0].dot(along))
    return F.when(F.abs(plane[0].dot(along)) > EPSILON, F.when(t >= 0, t))


def ray_sphere(start: V3, along: V3, center: V3, radius) -> F.Column:
    d = start.minus(center)
    b, c = d.dot(along), d.squared() - col(radius) * col(radius)
    disc = b * b - c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(disc >= 0, F.when(-b - root >= 0, -b - root).when(-b + root >= 0, -b + root))


def ray_box(start: V3, along: V3, low: V3, high: V3) -> F.Column:
    """t of the first point in the box (0 from inside), null if it is missed."""
    enter, leave, miss = [F.lit(0.0)], [F.lit(INFINITY)], F.lit(False)
    for s, d, a, b in zip(start, along, low, high, strict=True):
        flat = F.abs(d) < 1e-12
        t1, t2 = F.try_divide(a - s, d), F.try_divide(b - s, d)
        enter.append(F.when(flat, F.lit(0.0)).otherwise(F.least(t1, t2)))
        leave.append(F.when(flat, F.lit(INFINITY)).otherwise(F.greatest(t1, t2)))
        miss = miss | (flat & ~s.between(a, b))
    first = F.greatest(*enter)
    return F.when(~miss & (first <= F.least(*leave)), first)


def ray_triangle(start: V3, along: V3, a: V3, b: V3, c: V3) -> F.Column:
    """t of the hit, null if there is none (edges belong to the triangle)."""
    e1, e2 = b.minus(a), c.minus(a)
    h = along.cross(e2)
    det = e1.dot(h)
    s = start.minus(a)
    u, q = F.try_divide(s.dot(h), det), s.cross(e1)
    v, t = F.try_divide(along.dot(q), det), F.try_divide(e2.dot(q), det)
    return F.when((F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def plane_splits(low: V3, high: V3, plane: Plane) -> F.Column:
    """Does a plane go through a box?"""
    n = plane[0]
    mid = V3(*((a + b) / 2 for a, b in zip(low, high, strict=True)))
    reach = sum((F.abs(c) * (b - a) / 2 for c, a, b in zip(n, low, high, strict=True)), F.lit(0.0))
    return F.abs(point_plane_signed(mid, plane)) < reach


def circle_overlap_area(c1: V2, r1, c2: V2, r2) -> F.Column:
    r1, r2 = col(r1), col(r2)
    d = c1.minus(c2).norm()
    small, pi = F.least(r1, r2), F.lit(3.141592653589793)
    angle = lambda a, b: F.acos(clamp(F.try_divide(d * d + a * a - b * b, 2 * d * a), -1, 1))
    kite = F.sqrt(F.greatest((r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2), F.lit(0.0))) / 2
    lens = r1 * r1 * angle(r1, r2) + r2 * r2 * angle(r2, r1) - kite
    return F.when(d >= r1 + r2, F.lit(0.0)).when(d <= F.abs(r1 - r2), pi * small * small).otherwise(lens)


# directions and angles
def parallel(u: V3, v: V3, eps: float = EPSILON) -> F.Column:
    return F.abs(F.abs(u.dot(v)) - 1) < eps


def perpendicular(u: V3, v: V3, eps: float = EPSILON) -> F.Column:
    return F.abs(u.dot(v)) < eps


def angle(u: V3, v: V3) -> F.Column:
    return F.acos(clamp(F.coalesce(F.try_divide(u.dot(v), u.norm() * v.norm()), F.lit(1.0)), -1, 1))


def rotate(p: V3, axis: V3, radians: float) -> V3:
    """About a unit axis through the origin."""
    c, s = F.cos(F.lit(radians)), F.sin(F.lit(radians))
    return p.times(c).plus(axis.cross(p).times(s)).plus(axis.times(axis.dot(p) * (1 - c)))


def project_to_plane(p: V3, plane: Plane) -> V3:
    return p.minus(plane[0].times(point_plane_signed(p, plane)))


def project_to_line(p: V3, on: V3, along: V3) -> V3:
    return on.plus(along.times(p.minus(on).dot(along)))


def affine(p: V3, m: list[float]) -> V3:
    """A 4x4 matrix by rows, applied to a point."""
    return V3(*(m[4 * i] * p.x + m[4 * i + 1] * p.y + m[4 * i + 2] * p.z + m[4 * i + 3] for i in range(3)))


# triangles and boxes
def triangle_area(a: V3, b: V3, c: V3) -> F.Column:
    return b.minus(a).cross(c.minus(a)).norm() / 2


def triangle_aspect(a: V3, b: V3, c: V3) -> F.Column:
    """Product of the sides over 8 (s-a)(s-b)(s-c); the largest finite number where a side has no length."""
    la, lb, lc = point_point(b, c), point_point(c, a), point_point(a, b)
    s = (la + lb + lc) / 2
    ratio = F.try_divide(la * lb * lc, 8 * (s - la) * (s - lb) * (s - lc))
    return F.when(F.least(la, lb, lc) <= EPSILON, F.lit(INFINITY)).otherwise(F.coalesce(ratio, F.lit(INFINITY)))


def barycentric(p: V3, a: V3, b: V3, c: V3) -> V3:
    n = b.minus(a).cross(c.minus(a))
    whole = n.squared()
    part = lambda q, r: F.try_divide(r.minus(q).cross(p.minus(q)).dot(n), whole)
    return V3(part(b, c), part(c, a), part(a, b))


def box_area(low: V3, high: V3) -> F.Column:
    dx, dy, dz = (b - a for a, b in zip(low, high, strict=True))
    return 2 * (dx * dy + dy * dz + dz * dx)


def box_volume(low: V3, high: V3) -> F.Column:
    return (high.x - low.x) * (high.y - low.y) * (high.z - low.z)


def longest_axis(low: V3, high: V3) -> F.Column:
    dx, dy, dz = (b - a for a, b in zip(low, high, strict=True))
    return F.when((dx >= dy) & (dx >= dz), 0).when(dy >= dz, 1).otherwise(2)


def octant(p: V3, low: V3, high: V3) -> F.Column:
    return reduce(lambda a, b: a + b, ((c > (a + b) / 2).cast("int") * (1 << i) for i, (c, a, b) in enumerate(zip(p, low, high, strict=True))))


def box_union(low1: V3, high1: V3, low2: V3, high2: V3) -> tuple[V3, V3]:
    return V3(*map(F.least, low1, low2)), V3(*map(F.greatest, high1, high2))


def box_intersection(low1: V3, high1: V3, low2: V3, high2: V3) -> tuple[V3, V3]:
    """Empty if a low corner lies above the high one."""
    return V3(*map(F.greatest, low1, low2)), V3(*map(F.least, high1, high2))
