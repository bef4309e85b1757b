"""Synthetic images and small geometry, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.operators.grid import AXES, Size

Vector = Sequence[Column]


def grid(spark: SparkSession, size: Size, image_id: int = 0) -> DataFrame:
    """(image_id, x, y, z) of all voxels."""
    sx, sy, sz = size
    i = F.col("id")
    return spark.range(sx * sy * sz).select(F.lit(image_id).cast("long").alias("image_id"), (i % sx).cast("int").alias("x"), (F.floor(i / sx) % sy).cast("int").alias("y"), F.floor(i / (sx * sy)).cast("int").alias("z"))


def from_centre(size: Size) -> Column:
    """Distance of a voxel to the centre, size / 2."""
    return F.sqrt(sum((F.pow(F.col(a) - n / 2, 2) for a, n in zip(AXES[1:], size[1:], strict=True)), F.pow(F.col("x") - size[0] / 2, 2)))


def ball(size: Size, diameter: float, value: float = 1.0, background: float = 0.0) -> Column:
    """value within a ball whose diameter is a share of the smallest side."""
    return F.when(from_centre(size) < diameter * min(size) / 2, float(value)).otherwise(float(background))


def bullseye(size: Size, diameters: Sequence[float], low: float = 0.5, high: float = 1.0) -> Column:
    """Three balls in each other: high, low and high within."""
    r = from_centre(size) / (min(size) / 2)
    outer, middle, inner = diameters
    return F.when(r < inner, float(high)).when(r < middle, float(low)).when(r < outer, float(high)).otherwise(0.0)


def lines(every: int) -> Column:
    """1 where a coordinate is a multiple of ``every``."""
    out = F.lit(False)
    for a in AXES:
        out = out | (F.col(a) % every == 0)
    return F.when(out, 1.0).otherwise(0.0)


def dilation(size: Size, most: float) -> list[Column]:
    """Displacements away from the centre that grow with the distance, up to ``most`` at the corner; 0 at the centre."""
    d = from_centre(size)
    furthest = float(sum((n / 2) ** 2 for n in size) ** 0.5)
    return [F.when(d > 0, (F.col(a) - n / 2) / d * most * d / furthest).otherwise(0.0) for a, n in zip(AXES, size, strict=True)]


def dot(p: Vector, q: Vector) -> Column:
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def cross(p: Vector, q: Vector) -> list[Column]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def minus(p: Vector, q: Vector) -> list[Column]:
    return [a - b for a, b in zip(p, q, strict=True)]


def midpoint(p: Vector, q: Vector) -> list[Column]:
    return [(a + b) / 2 for a, b in zip(p, q, strict=True)]


def on_plane(start: Vector, direction: Vector, point: Vector, normal: Vector) -> tuple[Column, list[Column]]:
    """(t, place) where a line meets a plane; null if it is parallel to it."""
    along = dot(direction, normal)
    t = F.when(F.abs(along) > 1e-12, dot(minus(point, start), normal) / along)
    return t, [s + t * d for s, d in zip(start, direction, strict=True)]


def in_triangle(place: Vector, corners: Sequence[Vector]) -> Column:
    """Whether a place in the plane of a triangle is within it, its edges included."""
    a, b, c = corners
    n = cross(minus(b, a), minus(c, a))
    inside = [dot(cross(minus(q, p), minus(place, p)), n) >= -1e-12 for p, q in ((a, b), (b, c), (c, a))]
    return inside[0] & inside[1] & inside[2]


def ray_hit(start: Vector, direction: Vector, corners: Sequence[Vector]) -> Column:
    """Distance along a ray to a triangle, in lengths of its direction; null if it misses."""
    a, b, c = corners
    t, place = on_plane(start, direction, a, cross(minus(b, a), minus(c, a)))
    return F.when((t >= 0) & in_triangle(place, corners), t)


def frame(normal: Vector) -> list[list[Column]]:
    """Two unit vectors at right angles to a normal and to each other, and the unit normal."""
    unit = lambda v: [x / F.sqrt(dot(v, v)) for x in v]
    n = unit(normal)
    flat = F.abs(n[0]) < 0.9
    helper = [F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0)]
    first = unit(cross(n, helper))
    return [first, cross(n, first), n]
