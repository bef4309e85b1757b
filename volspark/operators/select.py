"""Regions: boxes, masks, decimation, flips, flood fill."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.grid import AXES, Size


def in_box(start: Sequence[int], size: Sequence[int]) -> Column:
    """The box [start, start + size), whose last index is inclusive at start + size - 1."""
    out = F.lit(True)
    for a, s, n in zip(AXES, start, size, strict=True):
        out = out & F.col(a).between(s, s + n - 1)
    return out


def extract(rows: DataFrame, start: Sequence[int], size: Sequence[int]) -> DataFrame:
    """The box as an image of its own, indices from 0."""
    return rows.filter(in_box(start, size)).withColumns({a: F.col(a) - s for a, s in zip(AXES, start, strict=True)})


def world_box(start: Sequence[float], end: Sequence[float], origin: Sequence[float], spacing: Sequence[float], size: Size) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """First index and size of the box of voxels between two world places, both included, as far as it is in the grid."""
    low = [max(0, math.ceil((s - o) / d - 1e-9)) for s, o, d in zip(start, origin, spacing, strict=True)]
    high = [min(n - 1, math.floor((e - o) / d + 1e-9)) for e, o, d, n in zip(end, origin, spacing, size, strict=True)]
    return tuple(low), tuple(max(0, h - lo + 1) for lo, h in zip(low, high, strict=True))


def fill_box(rows: DataFrame, start: Sequence[int], size: Sequence[int], value: float) -> DataFrame:
    return rows.withColumn("v", F.when(in_box(start, size), float(value)).otherwise(F.col("v")))


def copy_box(source: DataFrame, target: DataFrame, start: Sequence[int], size: Sequence[int], to: Sequence[int], kind: str = "same") -> DataFrame:
    """target with the box of source at ``to``; kind is same, cast (towards 0) or round (half away from 0)."""
    value = {"same": F.col("v"), "cast": F.col("v").cast("long").cast("double"), "round": F.round("v")}[kind]
    moved = source.filter(in_box(start, size)).select("image_id", *[(F.col(a) - s + t).alias(a) for a, s, t in zip(AXES, start, to, strict=True)], value.alias("new"))
    return target.join(moved, ["image_id", *AXES], "left").withColumn("v", F.coalesce("new", "v")).drop("new")


def masked(source: Column, kept: Column, mask: Column, low: float, high: float) -> Column:
    """source where low <= mask <= high, else kept."""
    return F.when(mask.between(low, high), source).otherwise(kept)


def downsample(rows: DataFrame, size: Size, factors: Sequence[int]) -> DataFrame:
    """Every n-th voxel; the new size is max(size // n, 1)."""
    keep = F.lit(True)
    for a, n, f in zip(AXES, size, factors, strict=True):
        keep = keep & (F.col(a) % f == 0) & (F.floor(F.col(a) / f) < max(n // f, 1))
    return rows.filter(keep).withColumns({a: F.floor(F.col(a) / f).cast("int") for a, f in zip(AXES, factors, strict=True)})


def flip(rows: DataFrame, size: Size, axes: str) -> DataFrame:
    return rows.withColumns({a: size[AXES.index(a)] - 1 - F.col(a) for a in axes})


def orient(rows: DataFrame, size: Size, order: str, flipped: str = "") -> DataFrame:
    """Permute the axes (``order`` names the old axis of each new one) and mirror some of the new ones."""
    new = {a: size[AXES.index(o)] - 1 - F.col(o) if a in flipped else F.col(o) for a, o in zip(AXES, order, strict=True)}
    return rows.withColumns(new)


def flood_fill(rows: DataFrame, seeds: DataFrame, low: float, high: float) -> DataFrame:
    """(image_id, x, y, z) that 6-connected steps within [low, high] reach from seeds, until nothing new is reached.

    A seed counts only if its own value is within the range. Only the last
    frontier is joined in each step; each frontier is kept once.
    """
    from volspark.plans.state import cut

    open_ = cut(rows.filter(F.col("v").between(low, high)).select("image_id", *AXES))
    key = ["image_id", *AXES]
    frontier = cut(open_.join(seeds.select(*key), key, "left_semi"))
    reached, before = frontier, None
    near = F.array(*[F.struct(*[(F.col(b) + (d if a == b else 0)).alias(b) for b in AXES]) for a in AXES for d in (-1, 1)])
    while not frontier.isEmpty():
        moved = frontier.select("image_id", F.explode(near).alias("p")).select("image_id", "p.*").distinct()
        # A step reaches only what the last two frontiers don't hold: older ones are two steps away or more.
        new = open_.join(moved, key, "left_semi").join(frontier, key, "left_anti")
        before, frontier = frontier, cut(new if before is None else new.join(before, key, "left_anti"))
        reached = reached.unionByName(frontier)
    return reached
