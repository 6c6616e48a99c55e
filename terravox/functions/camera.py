"""Cameras as Columns: extrinsics, pinhole projection, lens distortion, pose interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .vec import V2, V3, col


def world_to_camera(p: V3, eye: V3, towards: V3, up: V3) -> V3:
    """x to the right, y up, z against the view direction (a point in front has negative z)."""
    d = p.minus(eye)
    return V3(d.dot(towards.cross(up)), d.dot(up), -d.dot(towards))


def camera_to_world(p: V3, eye: V3, towards: V3, up: V3) -> V3:
    return eye.plus(towards.cross(up).times(p.x)).plus(up.times(p.y)).plus(towards.times(-p.z))


def camera_to_image(p: V3, fx, fy, cx, cy) -> V2:
    """Pixel of a point in front; null behind the camera."""
    depth = -p.z
    return V2(*(F.when(depth > 0, F.try_divide(c * col(f), depth) + col(o)) for c, f, o in ((p.x, fx, cx), (p.y, fy, cy))))


def image_to_camera(p: V2, depth: F.Column, fx, fy, cx, cy) -> V3:
    return V3((p.x - col(cx)) * depth / col(fx), (p.y - col(cy)) * depth / col(fy), -depth)


def distort(p: V2, k1, k2, k3, p1, p2) -> V2:
    """Radial and tangential terms, in normalised coordinates."""
    r2 = p.x * p.x + p.y * p.y
    radial = 1 + col(k1) * r2 + col(k2) * r2 * r2 + col(k3) * r2 * r2 * r2
    return V2(p.x * radial + 2 * col(p1) * p.x * p.y + col(p2) * (r2 + 2 * p.x * p.x), p.y * radial + col(p1) * (r2 + 2 * p.y * p.y) + 2 * col(p2) * p.x * p.y)


def undistort(p: V2, k1: float, k2: float, k3: float, p1: float, p2: float, rounds: int = 8) -> V2:
    """Fixed-point inverse of distort(), as a fold over a short array so that the expression stays small."""
    start = F.struct(p.x.alias("x"), p.y.alias("y"))

    def once(s: F.Column, _: F.Column) -> F.Column:
        q = distort(V2(s["x"], s["y"]), k1, k2, k3, p1, p2)
        return F.struct((p.x - (q.x - s["x"])).alias("x"), (p.y - (q.y - s["y"])).alias("y"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, once)
    return V2(out["x"], out["y"])


def slerp(a: tuple[F.Column, ...], b: tuple[F.Column, ...], t: F.Column) -> tuple[F.Column, ...]:
    """Between unit quaternions, the short way round; linear where they nearly agree."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    s = F.sin(angle)
    wa = F.when(s > 1e-9, F.try_divide(F.sin((1 - t) * angle), s)).otherwise(1 - t)
    wb = F.when(s > 1e-9, F.try_divide(F.sin(t * angle), s)).otherwise(t) * sign
    return tuple(wa * x + wb * y for x, y in zip(a, b, strict=True))


def normalised(q: tuple[F.Column, ...]) -> tuple[F.Column, ...]:
    n = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    return tuple(F.try_divide(x, n) for x in q)
