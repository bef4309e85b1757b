"""Maps of values and of vectors at a voxel, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.grid import AXES, Size

#: Fixed value: the offset that makes signed CT values unsigned.
CT_OFFSET = 1024


def fill(value: float) -> Column:
    return F.lit(float(value))


def scale(v: Column, factor: float) -> Column:
    return v * factor


def add(v: Column, offset: float) -> Column:
    return v + offset


def rescale(v: Column, low: Column, high: Column, out_low: float = 0.0, out_high: float = 1.0) -> Column:
    """Linear intensity window with clamping; a window without width maps to out_low."""
    ramp = out_low + (v - low) * (out_high - out_low) / (high - low)
    return F.when(v < low, out_low).when(v > high, out_high).when(high == low, out_low).otherwise(ramp)


def rescale_images(rows: DataFrame, out_low: float = 0.0, out_high: float = 1.0) -> DataFrame:
    """Window each image from its own minimum and maximum."""
    from pyspark.sql import Window as W

    image = W.partitionBy("image_id")
    return rows.withColumn("v", rescale(F.col("v"), F.min("v").over(image), F.max("v").over(image), out_low, out_high))


def threshold(v: Column, level: float, value: float = 1.0) -> Column:
    """value where v > level (strict), else 0."""
    return F.when(v > level, float(value)).otherwise(0.0)


def unsigned_shift(rows: DataFrame) -> DataFrame:
    """Images with a negative value are shifted by a constant."""
    from pyspark.sql import Window as W

    least = F.min("v").over(W.partitionBy("image_id"))
    return rows.withColumn("v", F.when(least < 0, F.col("v") + CT_OFFSET).otherwise(F.col("v")))


def tukey(size: Size, width: int) -> Column:
    """Raised-cosine taper: the product of the masks of the borders that a voxel is near to."""
    out = F.lit(1.0)
    for a, n in zip(AXES, size, strict=True):
        x = F.col(a)
        for i in (x, n - 1 - x):
            out = out * F.when(i < width, 0.5 * (1 - F.cos(math.pi * i / width))).otherwise(1.0)
    return out


def combine(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Elementwise operation on the dense volumes of the same image_id: one join row an image, not a voxel."""
    right = b.select("image_id", F.col("data").alias("other"))
    return a.join(right, "image_id").select("image_id", F.zip_with("data", "other", op).alias("data"))


def velocity_to_h(components: Sequence[str] = ("vx", "vy", "vz"), delta: float = 1.0, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> list[Column]:
    """h(x) = x + v * delta / spacing."""
    return [F.col(a) + F.col(c) * delta / float(s) for a, c, s in zip(AXES, components, spacing, strict=True)]


def h_to_velocity(components: Sequence[str] = ("hx", "hy", "hz"), spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> list[Column]:
    """v = (h - x) * spacing."""
    return [(F.col(c) - F.col(a)) * float(s) for a, c, s in zip(AXES, components, spacing, strict=True)]


def zeroth_order_inverse(components: Sequence[str] = ("hx", "hy", "hz")) -> list[Column]:
    """2x - h(x)."""
    return [2 * F.col(a) - F.col(c) for a, c in zip(AXES, components, strict=True)]


def norm(components: Sequence[str]) -> Column:
    return F.sqrt(dot(components, components))


def dot(a: Sequence[str], b: Sequence[str]) -> Column:
    return sum((F.col(p) * F.col(q) for p, q in zip(a[1:], b[1:], strict=True)), F.col(a[0]) * F.col(b[0]))


def affine(matrix: Sequence[float], shift: Sequence[float], at: Sequence[Column] | None = None) -> list[Column]:
    """Row-major 3x3 matrix times the coordinates, plus the shift."""
    at = at or [F.col(a) for a in AXES]
    return [sum((at[j] * float(matrix[3 * i + j]) for j in range(1, 3)), at[0] * float(matrix[3 * i])) + float(shift[i]) for i in range(3)]


def inverse_affine(matrix: Sequence[float], shift: Sequence[float]) -> tuple[list[float], list[float]]:
    """Matrix and shift of the inverse map."""
    import numpy as np

    m = np.linalg.inv(np.array(matrix, dtype=np.float64).reshape(3, 3))
    return m.ravel().tolist(), (-m @ np.array(shift, dtype=np.float64)).tolist()


def chained_affine(first: tuple[Sequence[float], Sequence[float]], then: tuple[Sequence[float], Sequence[float]]) -> tuple[list[float], list[float]]:
    """Matrix and shift of one map after another."""
    import numpy as np

    a, b = (np.array(t[0], dtype=np.float64).reshape(3, 3) for t in (first, then))
    return (b @ a).ravel().tolist(), (b @ np.array(first[1], dtype=np.float64) + np.array(then[1], dtype=np.float64)).tolist()


def interpolate(a: Column, b: Column, t: float) -> Column:
    return a * (1 - t) + b * t
