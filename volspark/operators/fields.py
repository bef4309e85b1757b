"""Deformation fields: h (places), u (displacements), v (world velocities).

A field is a row with an array for each component. The convention is never
guessed: each function names what it takes. Algebra of the fields of one image
happens within its row; fields of two tables are joined by image_id first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators import kernels
from volspark.operators.grid import AXES, Size
from volspark.operators.interp import PLACE

U = ("ux", "uy", "uz")
H = ("hx", "hy", "hz")
G = ("gx", "gy", "gz")


def is_h_field(rows: DataFrame, components: Sequence[str] = U) -> DataFrame:
    """Whether the values of voxels are nearer to the identity than to zero."""
    to_identity = sum((F.pow(F.col(c) - F.col(a), 2) for c, a in zip(components, AXES, strict=True)), F.lit(0.0))
    to_zero = sum((F.pow(F.col(c), 2) for c in components), F.lit(0.0))
    return rows.groupBy("image_id").agg((F.sum(to_identity) < F.sum(to_zero)).alias("is_h"))


def to_h(u: DataFrame, delta: float = 1.0) -> DataFrame:
    """Places x + delta u of voxels."""
    return u.select("image_id", *AXES, *[(F.col(a) + delta * F.col(c)).alias(h) for a, c, h in zip(AXES, U, H, strict=True)])


def stack(s: kernels.Stacks, names: Sequence[str], size: Size) -> np.ndarray:
    """(B, 3, z, y, x) of three arrays."""
    return np.stack([s[n].reshape(-1, *size[::-1]) for n in names], 1)


def named(field: np.ndarray, names: Sequence[str] = H) -> kernels.Stacks:
    return {n: field[:, i] for i, n in enumerate(names)}


def scaled(size: Size, spacing: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Identity and spacing in the shape of a stack of fields."""
    return kernels.identity(size)[None], np.array(spacing, dtype=np.float64).reshape(1, 3, 1, 1, 1)


def with_places(fields: DataFrame, size: Size, sign: float = 1.0, spacing: Sequence[float] = (1, 1, 1), components: Sequence[str] = U) -> DataFrame:
    """Adds px, py, pz = x + sign * u / spacing as arrays; an expression of the row's own arrays."""
    sx, sy, _ = size
    index = (lambda i: i % sx, lambda i: F.floor(i / sx) % sy, lambda i: F.floor(i / (sx * sy)))

    def place(at: Callable[[Column], Column], s: float) -> Callable[[Column, Column], Column]:
        return lambda u, i: at(i) + sign * u / float(s)

    return fields.select("*", *[F.transform(c, place(at, s)).alias(p) for p, c, at, s in zip(PLACE, components, index, spacing, strict=True)])


def of_affine(rows: DataFrame, size: Size, matrix: Sequence[float], shift: Sequence[float], inverse: bool = False) -> DataFrame:
    """Adds hx, hy, hz, the places of an affine map (or of its inverse), to rows of images."""
    from volspark.operators.pointwise import inverse_affine

    m, t = inverse_affine(matrix, shift) if inverse else (matrix, shift)
    sx, sy, sz = size
    every = F.sequence(F.lit(0), F.lit(sx * sy * sz - 1))

    def place(k: int) -> Callable[[Column], Column]:
        return lambda i: (i % sx) * float(m[3 * k]) + F.floor(i / sx) % sy * float(m[3 * k + 1]) + F.floor(i / (sx * sy)) * float(m[3 * k + 2]) + float(t[k])

    return rows.select("*", *[F.transform(every, place(k)).alias(h) for k, h in enumerate(H)])


def dots(a: DataFrame, b: DataFrame, components: Sequence[str] = U) -> DataFrame:
    """(image_id, dot): the sum of the products of the vectors of two fields with the same image_id."""
    other = b.select("image_id", *[F.col(c).alias(f"_{c}") for c in components])
    parts = [F.aggregate(F.zip_with(c, f"_{c}", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for c in components]
    return a.join(other, "image_id").select("image_id", (parts[0] + parts[1] + parts[2]).alias("dot"))


def compose(fields: DataFrame, size: Size, f: Sequence[str] = H, g: Sequence[str] = G, strategy: str = "id") -> DataFrame:
    """(image_id, hx, hy, hz): f(g(x)) of two fields of places in one row."""
    return kernels.map_images(fields, lambda s: named(kernels.sample(stack(s, f, size), stack(s, g, size), strategy)), list(dict.fromkeys([*f, *g])), H)


def compose_vh(fields: DataFrame, size: Size, sign: float = 1.0, spacing: Sequence[float] = (1, 1, 1), v: Sequence[str] = U, g: Sequence[str] = H) -> DataFrame:
    """g(x) + sign * v(g(x)) / spacing; v is zero outside of the grid."""
    _, unit = scaled(size, spacing)

    def run(s: kernels.Stacks) -> kernels.Stacks:
        at = stack(s, g, size)
        return named(at + sign * kernels.sample(stack(s, v, size), at) / unit)

    return kernels.map_images(fields, run, [*v, *g], H)


def compose_hv(fields: DataFrame, size: Size, sign: float = 1.0, spacing: Sequence[float] = (1, 1, 1), strategy: str = "id", g: Sequence[str] = H, v: Sequence[str] = U) -> DataFrame:
    """g(x + sign * v(x) / spacing)."""
    x, unit = scaled(size, spacing)
    return kernels.map_images(fields, lambda s: named(kernels.sample(stack(s, g, size), x + sign * stack(s, v, size) / unit, strategy)), [*g, *v], H)


def compose_hv_inverse_iterative(fields: DataFrame, size: Size, iterations: int = 5, spacing: Sequence[float] = (1, 1, 1), strategy: str = "id", g: Sequence[str] = H, v: Sequence[str] = U) -> DataFrame:
    """g(y(x)) where y solves y + v(y) / spacing = x, found by the fixed point y <- x - v(y) / spacing."""
    x, unit = scaled(size, spacing)

    def run(s: kernels.Stacks) -> kernels.Stacks:
        velocity = stack(s, v, size)
        y = np.repeat(x, len(velocity), 0)
        for _ in range(iterations):
            y = x - kernels.sample(velocity, y, "clamp") / unit
        return named(kernels.sample(stack(s, g, size), y, strategy))

    return kernels.map_images(fields, run, [*g, *v], H)


def translated(fields: DataFrame, size: Size, before: Sequence[float] = (0, 0, 0), after: Sequence[float] = (0, 0, 0), strategy: str = "id", h: Sequence[str] = H) -> DataFrame:
    """h(x + before) + after."""
    x, _ = scaled(size, (1, 1, 1))
    b, a = (np.array(t, dtype=np.float64).reshape(1, 3, 1, 1, 1) for t in (before, after))

    def run(s: kernels.Stacks) -> kernels.Stacks:
        field = stack(s, h, size)
        return named(kernels.sample(field, np.repeat(x + b, len(field), 0), strategy) + a if b.any() else field + a)

    return kernels.map_images(fields, run, h, H)


def group_exponential(fields: DataFrame, size: Size, steps: int, t: float = 1.0, v: Sequence[str] = U) -> DataFrame:
    """Scaling and squaring: x + t / 2^n v, composed with itself n times, all in the task of the row."""
    x, _ = scaled(size, (1, 1, 1))

    def run(s: kernels.Stacks) -> kernels.Stacks:
        h = x + t / 2**steps * stack(s, v, size)
        for _ in range(steps):
            h = kernels.sample(h, h, "id")
        return named(h)

    return kernels.map_images(fields, run, v, H)


def invert(fields: DataFrame, size: Size, iterations: int = 5, u: Sequence[str] = U) -> DataFrame:
    """Inverse of x + u(x) by the fixed point h(x) = x - u(h(x)), starting from the identity."""
    x, _ = scaled(size, (1, 1, 1))

    def run(s: kernels.Stacks) -> kernels.Stacks:
        shift = stack(s, u, size)
        h = np.repeat(x, len(shift), 0)
        for _ in range(iterations):
            h = x - kernels.sample(shift, h, "clamp")
        return named(h)

    return kernels.map_images(fields, run, u, H)


def inverse_consistency(fields: DataFrame, size: Size, margin: int = 30, h: Sequence[str] = H, inverse: Sequence[str] = G) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of |inverse(h(x)) - x| for voxels at least ``margin`` from the border."""
    x, _ = scaled(size, (1, 1, 1))
    inner = tuple(slice(margin, n - margin) for n in size[::-1])

    def run(s: kernels.Stacks) -> kernels.Stacks:
        moved = kernels.sample(stack(s, inverse, size), stack(s, h, size), "id")
        return {"e": np.sqrt(((moved - x) ** 2).sum(1))[(slice(None), *inner)]}

    errors = kernels.map_images(fields, run, [*h, *inverse], ["e"]).select("image_id", F.explode("e").alias("e"))
    return errors.groupBy("image_id").agg(F.min("e").alias("min_e"), F.max("e").alias("max_e"), F.avg("e").alias("mean_e"), F.stddev_samp("e").alias("std_e"))


def resample(fields: DataFrame, size: Size, new_size: Size, h: Sequence[str] = H) -> DataFrame:
    """A field of places in a grid of another size over the same extent, in the new index coordinates."""
    return kernels.map_images(fields, lambda s: named(kernels.resize_places(stack(s, h, size), new_size)), h, H)


def inverse_of_points(fields: DataFrame, points: DataFrame, size: Size, reach: float = 2.0, h: Sequence[str] = H) -> DataFrame:
    """(image_id, point_id, x, y, z) with h(x, y, z) near the point, from points (image_id, point_id, px, py, pz).

    The voxel whose place is closest starts, and one first-order step with the
    inverse of the derivative there (the identity where it is singular) refines
    it. A point whose closest place is further than ``reach`` has nulls. The
    points of an image are looked up in the row of its field, BLOCK at a time.
    """
    many = points.groupBy("image_id", F.pmod(F.xxhash64("point_id"), F.lit(64)).alias("part")).agg(F.array_sort(F.collect_list(F.struct("point_id", *PLACE))).alias("p"))
    rows = fields.join(many, "image_id").select("image_id", *h, F.col("p.point_id").alias("ids"), *[F.col(f"p.{c}").alias(c) for c in PLACE])

    def run(s: kernels.Stacks) -> kernels.Stacks:
        out = []
        for i in range(len(s["ids"])):
            field = np.stack([s[n][i].reshape(size[::-1]) for n in h])
            want = np.stack([s[c][i] for c in PLACE], 1)
            found = np.concatenate([_inverse(field, want[a : a + BLOCK], reach) for a in range(0, len(want), BLOCK)])
            out.append(found.T)
        return {a: np.stack([o[k] for o in out]) for k, a in enumerate(AXES)} | {"out": s["ids"]}

    # A call has one image, as the images have different numbers of points.
    found = kernels.map_images(rows, run, [*h, "ids", *PLACE], ["out", *AXES], stack=1)
    flat = found.select("image_id", F.explode(F.arrays_zip("out", *AXES)).alias("p"))
    return flat.select("image_id", F.col("p.out").cast("long").alias("point_id"), *[F.when(~F.isnan(f"p.{a}"), F.col(f"p.{a}")).alias(a) for a in AXES])


#: Points that are compared with a field at once.
BLOCK = 64


def _inverse(field: np.ndarray, want: np.ndarray, reach: float) -> np.ndarray:
    places = field.reshape(3, -1)
    distance = ((places[None] - want[:, :, None]) ** 2).sum(1)
    at = distance.argmin(1)
    z, y, x = np.unravel_index(at, field.shape[1:])
    derivative = np.stack([kernels.gradient(field[None, i])[0] for i in range(3)])[:, :, z, y, x].transpose(2, 0, 1)
    singular = np.abs(np.linalg.det(derivative)) < 1e-12
    derivative[singular] = np.eye(3)
    step = np.linalg.solve(derivative, (want - places[:, at].T)[:, :, None])[:, :, 0]
    out = np.stack([x, y, z], 1) + step
    out[distance[np.arange(len(at)), at] > reach**2] = np.nan
    return out
