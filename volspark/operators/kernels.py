"""Numpy kernels over stacks of images and fields, and the Arrow function that runs them.

A stack has the shape (B, z, y, x), a stack of fields (B, 3, z, y, x). An image
is one row with its arrays, so places are looked up by index within the task of
the row, and no voxel is shuffled. A call gets STACK values at most, or one
image, so tasks need memory for a few images only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Size = tuple[int, int, int]
Stacks = dict[str, np.ndarray]

#: Values that a call gets, in all its columns; what it makes on the way is some times as much.
STACK = 1 << 17


def identity(size: Size) -> np.ndarray:
    """(3, z, y, x): x, y and z of each voxel."""
    z, y, x = np.meshgrid(*[np.arange(n, dtype=np.float64) for n in size[::-1]], indexing="ij")
    return np.stack([x, y, z])


def _low(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower corners and the parts beyond them, (B, 3, n); places that aren't finite are far outside."""
    place = np.clip(np.nan_to_num(p.reshape(len(p), 3, -1), nan=-1e9), -1e9, 1e9)
    low = np.floor(place)
    return low.astype(np.int64), place - low


def _flat(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return at[:, 0] + n[0] * (at[:, 1] + n[1] * at[:, 2])


def sample(v: np.ndarray, p: np.ndarray, strategy: str = "value", background: float = 0.0) -> np.ndarray:
    """Trilinear values (B, C, ...) of v (B, C, z, y, x) at the places p (B, 3, ...).

    strategy says what a corner outside of the grid counts as: "value" the
    background, "clamp" the nearest voxel, "wrap" the periodic one, "id" the
    corner's own coordinates (v has three components then).
    """
    b, c = v.shape[:2]
    n = np.array(v.shape[:1:-1])
    flat, (low, part) = v.reshape(b, c, -1), _low(p)
    out = np.zeros((b, c, low.shape[2]))
    for corner in product((0, 1), repeat=3):
        bit = np.array(corner)[None, :, None]
        at, w = low + bit, np.where(bit, part, 1 - part).prod(1)
        near = at % n[:, None] if strategy == "wrap" else np.clip(at, 0, (n - 1)[:, None])
        value = np.take_along_axis(flat, _flat(near, n)[:, None], 2)
        if strategy in ("value", "id"):
            inside = (at == near).all(1)[:, None]
            value = np.where(inside, value, at.astype(np.float64) if strategy == "id" else background)
        out += w[:, None] * value
    return out.reshape(b, c, *p.shape[2:])


def nearest(v: np.ndarray, p: np.ndarray, background: float = 0.0) -> np.ndarray:
    """The voxel at the truncation of (p + 1/2), so places below -1/2 round towards 0; outside, the background."""
    n = np.array(v.shape[:1:-1])
    at = np.trunc(np.clip(np.nan_to_num(p.reshape(len(p), 3, -1), nan=-1e9), -1e9, 1e9) + 0.5).astype(np.int64)
    near = np.clip(at, 0, (n - 1)[:, None])
    value = np.take_along_axis(v.reshape(*v.shape[:2], -1), _flat(near, n)[:, None], 2)
    return np.where((at == near).all(1)[:, None], value, background).reshape(*v.shape[:2], *p.shape[2:])


def _cubic_weights(t: np.ndarray) -> list[np.ndarray]:
    """Catmull-Rom weights of the four samples around a place, t in [0, 1) from the second."""
    return [(-t + 2 * t**2 - t**3) / 2, (2 - 5 * t**2 + 3 * t**3) / 2, (t + 4 * t**2 - 3 * t**3) / 2, (-(t**2) + t**3) / 2]


def cubic(v: np.ndarray, p: np.ndarray, background: float = 0.0) -> np.ndarray:
    """64-tap cubic values; taps outside count as the background."""
    b, c = v.shape[:2]
    n = np.array(v.shape[:1:-1])
    flat, (low, part) = v.reshape(b, c, -1), _low(p)
    weights, out = _cubic_weights(part), np.zeros((b, c, low.shape[2]))
    for tap in product(range(4), repeat=3):
        at = low + np.array(tap)[None, :, None] - 1
        near = np.clip(at, 0, (n - 1)[:, None])
        value = np.where((at == near).all(1)[:, None], np.take_along_axis(flat, _flat(near, n)[:, None], 2), background)
        out += (weights[tap[0]][:, 0] * weights[tap[1]][:, 1] * weights[tap[2]][:, 2])[:, None] * value
    return out.reshape(b, c, *p.shape[2:])


def scatter(v: np.ndarray, p: np.ndarray, size: Size, wrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums (B, z, y, x) of the values dealt over the corners of their places, and of their weights, NaN where nothing came."""
    b, (low, part) = len(v), _low(p)
    n, value = np.array(size), v.reshape(len(v), -1)
    sums, mass, hits = (np.zeros(b * n.prod()) for _ in range(3))
    for corner in product((0, 1), repeat=3):
        bit = np.array(corner)[None, :, None]
        at, w = low + bit, np.where(bit, part, 1 - part).prod(1)
        near = at % n[:, None] if wrap else np.clip(at, 0, (n - 1)[:, None])
        keep = np.ones(w.shape, bool) if wrap else (at == near).all(1)
        cell = (_flat(near, n) + (np.arange(b) * n.prod())[:, None])[keep]
        sums += np.bincount(cell, (w * value)[keep], len(sums))
        mass += np.bincount(cell, w[keep], len(sums))
        hits += np.bincount(cell, minlength=len(sums))
    shape = (b, *size[::-1])
    return np.where(hits > 0, sums, np.nan).reshape(shape), np.where(hits > 0, mass, np.nan).reshape(shape)


def splat(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Values dealt over the corners of their places in a grid of the same size; 0 where nothing came."""
    return np.nan_to_num(scatter(v, p, v.shape[:0:-1])[0])


def difference(v: np.ndarray, axis: int, wrap: bool = False) -> np.ndarray:
    """Central differences along x (0), y (1) or z (2); one-sided at the border, or periodic."""
    at = v.ndim - 1 - axis
    if v.shape[at] < 2:
        return np.zeros_like(v)
    return (np.roll(v, -1, at) - np.roll(v, 1, at)) / 2 if wrap else np.gradient(v, axis=at)


def gradient(v: np.ndarray) -> np.ndarray:
    """(B, 3, z, y, x) of a stack of images."""
    return np.stack([difference(v, a) for a in range(3)], 1)


def jacobian(h: np.ndarray) -> np.ndarray:
    """Determinants (B, z, y, x) of the derivatives of a stack of fields."""
    m = np.stack([gradient(h[:, i]) for i in range(3)], 1)
    return np.linalg.det(np.moveaxis(m, (1, 2), (-2, -1)))


def warp(v: np.ndarray, h: np.ndarray, background: float | None = 0.0) -> np.ndarray:
    """A stack of images at a stack of places; the nearest voxel counts outside if the background is None."""
    return sample(v[:, None], h, "clamp" if background is None else "value", background or 0.0)[:, 0]


def gaussian_taps(sigma: float, half: int) -> np.ndarray:
    w = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def blur(v: np.ndarray, sigma: Sequence[float], half: Sequence[int] | None = None) -> np.ndarray:
    """Separable Gaussian of a stack; near an end the taps inside are normalised; half widths, ceil(3 sigma) if not given, stop at size / 2 - 1."""
    for axis, s in enumerate(sigma):
        at = v.ndim - 1 - axis
        n = v.shape[at]
        k = min(int(np.ceil(3 * s)) if half is None else half[axis], n // 2 - 1)
        if s <= 0 or k < 1:
            continue
        line = np.moveaxis(v, at, -1)
        out, mass = np.zeros_like(line), np.zeros(n)
        for j, w in zip(range(-k, k + 1), gaussian_taps(s, k), strict=True):
            to, of = slice(max(0, -j), n - max(0, j)), slice(max(0, j), n - max(0, -j))
            out[..., to] += w * line[..., of]
            mass[to] += w
        v = np.moveaxis(out / mass, -1, at)
    return v


def resize(v: np.ndarray, size: Size, strategy: str = "clamp") -> np.ndarray:
    """A stack of images in a grid of another size over the same extent: the first and last voxels of a line meet."""
    old = v.shape[:0:-1]
    if tuple(old) == tuple(size):
        return v
    ratio = np.array([(o - 1) / (n - 1) if n > 1 else 0.0 for o, n in zip(old, size, strict=True)])
    places = np.broadcast_to(identity(size) * ratio[:, None, None, None], (len(v), 3, *size[::-1]))
    return sample(v[:, None], places, strategy)[:, 0]


def resize_places(h: np.ndarray, size: Size) -> np.ndarray:
    """A stack of fields of places (B, 3, z, y, x) in a grid of another size, in the new index coordinates."""
    old = h.shape[:1:-1]
    x, out = identity(tuple(old)), []
    for i in range(3):
        scale = (size[i] - 1) / (old[i] - 1) if old[i] > 1 else 1.0
        out.append(resize(h[:, i] - x[i], size) * scale + identity(size)[i])
    return np.stack(out, 1)


def _stacks(batches: Iterator[pa.RecordBatch], f: Callable[[Stacks], Stacks], values: Sequence[str], keep: Sequence[str], out: Sequence[str], schema: pa.Schema, most: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width = max(1, sum(len(batch.column(len(keep) + i).flatten()) for i in range(len(values))) // max(1, batch.num_rows))
        step = most or max(1, STACK // width)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            given = {v: part.column(len(keep) + i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1) for i, v in enumerate(values)}
            found = f(given)
            columns = [part.column(i).cast(schema.field(i).type) for i in range(len(keep))]
            for name in out:
                flat = np.ascontiguousarray(found[name], dtype=np.float64).reshape(part.num_rows, -1)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def map_images(images: DataFrame, f: Callable[[Stacks], Stacks], values: Sequence[str], out: Sequence[str], keep: Sequence[str] = ("image_id",), stack: int | None = None) -> DataFrame:
    """(*keep, *out arrays) of f over stacks of the arrays ``values``, each (B, n); the images of a call have one size.

    ``stack`` is the number of images of a call, if it isn't to be as many as STACK allows.

    Rows with a null array give no row, as there is nothing to look up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    rows = images.select(*keep, *[F.col(v).cast("array<double>").alias(v) for v in values]).dropna(subset=list(values))
    kind = StructType([*[rows.schema[k] for k in keep], *[StructField(o, ArrayType(DoubleType())) for o in out]])
    schema = to_arrow_schema(kind)
    return rows.mapInArrow(partial(_stacks, f=f, values=list(values), keep=list(keep), out=list(out), schema=pa.schema([pa.field(x.name, x.type if i < len(keep) else pa.list_(pa.float64())) for i, x in enumerate(schema)]), most=stack), kind)
