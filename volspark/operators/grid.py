"""Volumes as one row an image (dense) and as one row a voxel (long), x fastest.

Exploding shuffles nothing. Where windows or sums with image_id among their keys
follow, dense rows can be dealt by image_id first, so that these run without
shuffling voxels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

AXES = ("x", "y", "z")
Size = tuple[int, int, int]


def unpacked(images: DataFrame, size: Size, names: Sequence[str], *keep: str, dealt: bool = False) -> DataFrame:
    """(image_id, *keep, x, y, z, *names) from arrays, x fastest; NaN values are left out with their voxel."""
    sx, sy, _ = size
    i = F.col("i")
    rows = (images.repartition("image_id") if dealt else images).select("image_id", *keep, F.posexplode(F.arrays_zip(*names)).alias("i", "v"))
    at = [(i % sx).alias("x"), (F.floor(i / sx) % sy).cast("int").alias("y"), F.floor(i / (sx * sy)).cast("int").alias("z")]
    return rows.select("image_id", *keep, *at, *[F.col(f"v.{n}").cast("double").alias(n) for n in names]).filter(~F.isnan(names[0]) | F.col(names[0]).isNull())


def voxels(volumes: DataFrame, size: Size, data: str = "data", *keep: str, dealt: bool = False) -> DataFrame:
    """(image_id, *keep, x, y, z, v) from (image_id, data array)."""
    sx, sy, _ = size
    i = F.col("i")
    rows = (volumes.repartition("image_id") if dealt else volumes).select("image_id", *keep, F.posexplode(data).alias("i", "v"))
    return rows.select("image_id", *keep, (i % sx).alias("x"), F.floor(i / sx).cast("int").alias("y0"), F.col("v").cast("double").alias("v")).select(
        "image_id", *keep, "x", (F.col("y0") % sy).alias("y"), F.floor(F.col("y0") / sy).cast("int").alias("z"), "v"
    )


def dense(rows: DataFrame, size: Size, value: str = "v", name: str = "data", *keep: str) -> DataFrame:
    """(image_id, *keep, data) from voxels."""
    sx, sy, _ = size
    i = F.col("x") + sx * (F.col("y") + sy * F.col("z"))
    cells = F.array_sort(F.collect_list(F.struct(i.alias("i"), F.col(value).alias("v"))))
    return rows.groupBy("image_id", *keep).agg(cells.alias("c")).select("image_id", *keep, F.col("c.v").alias(name))


def line(axis: str, *keys: str) -> WindowSpec:
    """The voxels of an image along one axis, in order."""
    return W.partitionBy(*(keys or ("image_id",)), *[a for a in AXES if a != axis]).orderBy(axis)


def inside(size: Size, x: Column | None = None, y: Column | None = None, z: Column | None = None) -> Column:
    """Whether the index is within the grid."""
    at = [c if c is not None else F.col(a) for c, a in zip((x, y, z), AXES, strict=True)]
    return (at[0] >= 0) & (at[0] < size[0]) & (at[1] >= 0) & (at[1] < size[1]) & (at[2] >= 0) & (at[2] < size[2])


def interior(size: Size) -> Column:
    """Whether the voxel has all its neighbours."""
    out = F.lit(True)
    for a, n in zip(AXES, size, strict=True):
        out = out & (F.col(a) > 0) & (F.col(a) < n - 1)
    return out


def world(origin: Sequence[float], spacing: Sequence[float]) -> list[Column]:
    """World coordinates of a voxel: index * spacing + origin."""
    return [F.col(a) * float(s) + float(o) for a, o, s in zip(AXES, origin, spacing, strict=True)]
