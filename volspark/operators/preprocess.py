"""Preparation of images before they are registered: intensity window, border taper, blur, and a check that they are congruent."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.config import PreprocessParams
from volspark.operators import kernels
from volspark.operators.grid import Size


def taper(size: Size, width: int) -> np.ndarray:
    """(z, y, x): raised cosines towards the borders, where voxels are nearer than ``width``."""
    out = np.ones(size[::-1])
    for axis, n in enumerate(size):
        i = np.arange(n)
        line = np.ones(n)
        for near in (i, n - 1 - i):
            line *= np.where(near < width, 0.5 * (1 - np.cos(np.pi * near / max(width, 1))), 1.0)
        out *= line.reshape([-1 if 2 - axis == k else 1 for k in range(3)])
    return out


def preprocess(images: DataFrame, size: Size, params: PreprocessParams, keep: Sequence[str] = ("image_id",)) -> DataFrame:
    """``data`` of each image after its window (its own minimum and maximum if none is given), taper and blur."""
    mask = taper(size, params.tukey_width)

    def run(s: kernels.Stacks) -> kernels.Stacks:
        v = s["data"].reshape(-1, *size[::-1])
        low, high = params.window or (v.min((1, 2, 3), keepdims=True), v.max((1, 2, 3), keepdims=True))
        width = np.where(high == low, 1.0, np.subtract(high, low))
        v = params.out_low + (np.clip(v, low, high) - low) * (params.out_high - params.out_low) / width
        return {"data": kernels.blur(v * mask, [params.blur_sigma] * 3)}

    return kernels.map_images(images, run, ["data"], ["data"], keep)


def incongruent(headers: DataFrame, size: Sequence[int], origin: Sequence[float], spacing: Sequence[float], tolerance: float = 1e-6) -> DataFrame:
    """Headers (image_id, size, origin, spacing arrays) that differ from what is expected, in either direction."""
    differ = F.lit(False)
    for name, want in (("size", size), ("origin", origin), ("spacing", spacing)):
        for i, w in enumerate(want):
            differ = differ | (F.abs(F.col(name)[i] - F.lit(float(w))) > tolerance)
    return headers.filter(F.coalesce(differ, F.lit(True)))
