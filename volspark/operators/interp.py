"""Gathering (warps) and scattering (splats) between grids, one row an image.

Images carry their volumes and their fields of places as arrays (x fastest); a
warp looks the corners of each place up by index in the task of the row. Nothing
is shuffled by voxel. Places outside, and null arrays, are treated as kernels say.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators import kernels
from volspark.operators.grid import Size

PLACE = ("px", "py", "pz")


def _volumes(stacks: kernels.Stacks, names: Sequence[str], size: Size) -> np.ndarray:
    """(B, C, z, y, x) of the named arrays."""
    return np.stack([stacks[n].reshape(-1, *size[::-1]) for n in names], 1)



def warp(images: DataFrame, size: Size, places: Sequence[str] = PLACE, values: Sequence[str] = ("data",), method: str = "linear", strategy: str = "value", background: float = 0.0, keep: Sequence[str] = ("image_id",)) -> DataFrame:
    """The arrays ``values`` of each image at its places; method is linear, cubic or nearest."""

    def f(s: kernels.Stacks) -> kernels.Stacks:
        v, p = _volumes(s, values, size), np.stack([s[n] for n in places], 1)
        if method == "linear":
            out = kernels.sample(v, p, strategy, background)
        else:
            out = (kernels.cubic if method == "cubic" else kernels.nearest)(v, p, background)
        return {n: out[:, i] for i, n in enumerate(values)}

    return kernels.map_images(images, f, [*values, *[p for p in places if p not in values]], values, keep)


def warp_masked(images: DataFrame, size: Size, places: Sequence[str] = PLACE, background: float = 0.0) -> DataFrame:
    """``data`` at the places where ``mask`` is over 0, and as it is elsewhere."""

    def f(s: kernels.Stacks) -> kernels.Stacks:
        moved = kernels.sample(_volumes(s, ["data"], size), np.stack([s[n] for n in places], 1), "value", background)[:, 0]
        return {"data": np.where(s["mask"] > 0, moved, s["data"])}

    return kernels.map_images(images, f, ["data", "mask", *places], ["data"])


def splat(images: DataFrame, size: Size, places: Sequence[str] = PLACE, normalize: bool = False, wrap: bool = False, background: float = 0.0) -> DataFrame:
    """(image_id, data): each value of ``data`` dealt over the corners of its place; NaN where nothing came.

    With ``normalize``, sums are divided by the sum of weights, or the background where that is 0.
    """

    def f(s: kernels.Stacks) -> kernels.Stacks:
        sums, mass = kernels.scatter(s["data"], np.stack([s[n] for n in places], 1), size, wrap)
        if normalize:
            sums = np.where(mass > 0, sums / np.where(mass > 0, mass, 1), np.where(np.isnan(mass), np.nan, background))
        return {"data": sums}

    return kernels.map_images(images, f, ["data", *places], ["data"])


def resample(images: DataFrame, size: Size, new_size: Size, spacing: Sequence[float] = (1, 1, 1), new_spacing: Sequence[float] = (1, 1, 1), origin: Sequence[float] = (0, 0, 0), new_origin: Sequence[float] = (0, 0, 0), centred: bool = False, background: float = 0.0) -> DataFrame:
    """``data`` in another grid of world coordinates; ``centred`` aligns voxel centres rather than corners."""
    s, ns, o, no = (np.array(x, dtype=np.float64)[:, None, None, None] for x in (spacing, new_spacing, origin, new_origin))
    places = (kernels.identity(new_size) * ns + no + ((ns - s) / 2 if centred else 0.0) - o) / s

    def f(stacks: kernels.Stacks) -> kernels.Stacks:
        v = _volumes(stacks, ["data"], size)
        return {"data": kernels.sample(v, np.broadcast_to(places, (len(v), *places.shape)), "value", background)[:, 0]}

    return kernels.map_images(images, f, ["data"], ["data"])


def isotropic(images: DataFrame, size: Size, spacing: Sequence[float], axes: str = "xyz") -> tuple[DataFrame, Size, tuple[float, ...]]:
    """``data`` with the smallest spacing along the axes (all, or "z" for slices only), its size and its spacing."""
    least = min(spacing) if axes == "xyz" else min(spacing[i] for i in range(3) if "xyz"[i] not in axes)
    new = tuple(float(least) if a in axes else float(s) for a, s in zip("xyz", spacing, strict=True))
    new_size = tuple(max(1, int(np.floor((n - 1) * s / t + 1e-9)) + 1) for n, s, t in zip(size, spacing, new, strict=True))
    return resample(images, size, new_size, spacing, new), new_size, new


def affine(images: DataFrame, size: Size, matrix: Sequence[float], shift: Sequence[float], spacing: Sequence[float] = (1, 1, 1), origin: Sequence[float] = (0, 0, 0), background: float = 0.0) -> DataFrame:
    """``data`` at the affine places, which are in world coordinates where spacing and origin are given."""
    s, o = np.array(spacing, dtype=np.float64), np.array(origin, dtype=np.float64)
    x = kernels.identity(size).reshape(3, -1) * s[:, None] + o[:, None]
    places = ((np.array(matrix, dtype=np.float64).reshape(3, 3) @ x + np.array(shift, dtype=np.float64)[:, None] - o[:, None]) / s[:, None]).reshape(3, *size[::-1])

    def f(stacks: kernels.Stacks) -> kernels.Stacks:
        v = _volumes(stacks, ["data"], size)
        return {"data": kernels.sample(v, np.broadcast_to(places, (len(v), *places.shape)), "value", background)[:, 0]}

    return kernels.map_images(images, f, ["data"], ["data"])


def translate(images: DataFrame, size: Size, shift: Sequence[float], spacing: Sequence[float] = (1, 1, 1), background: float = 0.0) -> DataFrame:
    """``data`` moved by a shift in world coordinates."""
    return affine(images, size, (1, 0, 0, 0, 1, 0, 0, 0, 1), [-float(t) for t in shift], spacing, (0, 0, 0), background)


def at_points(images: DataFrame, points: DataFrame, size: Size, spacing: Sequence[float] = (1, 1, 1), origin: Sequence[float] = (0, 0, 0), background: float = 0.0) -> DataFrame:
    """(image_id, *columns of points, v): trilinear values at world points (image_id, x, y, z).

    The corners are joined to the voxels that they need only, for a few points in many images.
    """
    at = [(F.col(a) - float(o)) / float(s) for a, s, o in zip("xyz", spacing, origin, strict=True)]
    sx, sy, sz = size
    low = [F.floor(c) for c in at]
    value = F.lit(0.0)
    for bits in ((i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)):
        w = F.lit(1.0)
        for c, lo, b in zip(at, low, bits, strict=True):
            w = w * ((c - lo) if b else (1 - (c - lo)))
        i, j, k = (lo + b for lo, b in zip(low, bits, strict=True))
        inside = i.between(0, sx - 1) & j.between(0, sy - 1) & k.between(0, sz - 1)
        value = value + w * F.when(inside, F.get("data", (i + sx * (j + sy * k)).cast("int"))).otherwise(float(background))
    return points.join(images.select("image_id", "data"), "image_id").withColumn("v", value).drop("data")


def sinc_upsample(images: DataFrame, size: Size, factor: int) -> DataFrame:
    """``data`` on a finer grid by Fourier zero padding."""
    from volspark.operators.spectral import sinc_upsample as up

    return kernels.map_images(images, lambda s: {"data": np.stack([up(v.reshape(size[::-1]), factor) for v in s["data"]])}, ["data"], ["data"])


def refine_z(rows: DataFrame, size: Size, ratio: int) -> DataFrame:
    """Linear upsampling in z to (n - 1) * ratio + 1 slices; the last slice is itself."""
    if ratio <= 1:
        return rows
    from volspark.operators.grid import line

    n = size[2]
    after = F.coalesce(F.lead("v").over(line("z")), F.col("v"))
    step = F.explode(F.when(F.col("z") < n - 1, F.sequence(F.lit(0), F.lit(ratio - 1))).otherwise(F.array(F.lit(0)))).alias("k")
    rows = rows.withColumn("_after", after).select("*", step)
    t = F.col("k") / ratio
    return rows.withColumn("v", F.col("v") * (1 - t) + F.col("_after") * t).withColumn("z", F.col("z") * ratio + F.col("k")).drop("_after", "k")
