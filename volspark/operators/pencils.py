"""Fourier transforms of tiled volumes, one axis after the other.

The tiles of a line of tiles along an axis are sorted next to each other and make
up a pencil, whose lines are transformed; the pencil is cut into tiles again for
the next axis. A task holds one pencil (side * side lines), whatever the volume's
size. Complex values are pairs of arrays, real and imaginary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators import tiles as t
from volspark.operators.tiles import KEY, Tiling

_PENCIL = pa.schema([("image_id", pa.int64()), ("pencil", pa.int64()), ("place", pa.int64()), ("data", pa.binary())])


def along(rows: DataFrame, grid: Tiling, axis: int, names: Sequence[str], f: Callable[[np.ndarray], np.ndarray], out: Tiling | None = None) -> DataFrame:
    """Tiles of f over the lines along an axis (0 for x); f takes and gives (len(names), n, lines), and ``out`` has another size along the axis."""
    new, side, n = out or grid, grid.side, grid.size[axis]
    others = [a for a in range(3) if a != axis]
    m = len(names)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for image, tile, values in t._arrays(batches, 2):
                at = (grid.corner(tile) // side).tolist()
                pencil = at[others[0]] + grid.counts[others[0]] * at[others[1]]
                cube = np.moveaxis(np.stack(values).reshape(m, side, side, side), 3 - axis, 1)
                yield image, pencil, at[axis], np.ascontiguousarray(cube, dtype="<f8").tobytes()

        return t._bytes(parts(), _PENCIL)

    def transform(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[tuple]:
            for (image, pencil), parts in groupby(t._rows(batches), key=lambda r: (r[0], r[1])):
                line = np.zeros((m, grid.counts[axis] * side, side * side))
                for _, _, place, data in parts:
                    line[:, place * side : (place + 1) * side] = np.frombuffer(data, "<f8").reshape(m, side, -1)
                found = np.zeros((m, new.counts[axis] * side, side * side))
                found[:, : new.size[axis]] = f(line[:, :n])
                at = [0, 0, 0]
                at[others[0]], at[others[1]] = pencil % grid.counts[others[0]], pencil // grid.counts[others[0]]
                for place in range(new.counts[axis]):
                    at[axis] = place
                    cube = found[:, place * side : (place + 1) * side].reshape(m, side, side, side)
                    yield image, new.number(at), np.moveaxis(cube, 1, 3 - axis).reshape(m, -1)

        return t._lists(tiles(), names)

    sent = t._typed(rows, names).mapInArrow(send, "image_id long, pencil long, place long, data binary")
    return sent.repartition("image_id", "pencil").sortWithinPartitions("image_id", "pencil", "place").mapInArrow(transform, t._kind(names))


def _complex(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """f of complex lines for pairs of arrays."""

    def run(lines: np.ndarray) -> np.ndarray:
        found = f(lines[::2] + 1j * lines[1::2])
        return np.stack([found.real, found.imag], 1).reshape(2 * len(found), *found.shape[1:])

    return run


def with_imaginary(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds <name>_i, the imaginary parts of real arrays, all 0."""
    return rows.select(*KEY, *[c for n in names for c in (F.col(n), F.transform(n, lambda v: F.lit(0.0)).alias(f"{n}_i"))])


def pairs(names: Sequence[str]) -> list[str]:
    return [c for n in names for c in (n, f"{n}_i")]


def forward(rows: DataFrame, grid: Tiling, names: Sequence[str] = ("v",)) -> DataFrame:
    """The transform of real arrays, as <name> and <name>_i, in the order of frequencies of numpy."""
    return _each(with_imaginary(rows, names), grid, names, np.fft.fft)


def backward(rows: DataFrame, grid: Tiling, names: Sequence[str] = ("v",)) -> DataFrame:
    """The inverse transform, as <name> and <name>_i."""
    return _each(rows, grid, names, np.fft.ifft)


def _each(rows: DataFrame, grid: Tiling, names: Sequence[str], transform: Callable) -> DataFrame:
    for axis in range(3):
        rows = along(rows, grid, axis, pairs(names), _complex(lambda x: transform(x, axis=1)))
    return rows


def convolve(rows: DataFrame, grid: Tiling, response: Callable[[list[np.ndarray]], np.ndarray], names: Sequence[str] = ("v",)) -> DataFrame:
    """Real arrays convolved by a kernel that is given by its transform, a function of the angular frequencies along x, y and z."""

    def apply(tile: int, values: list[np.ndarray]) -> list[np.ndarray]:
        r = np.ravel(response(_frequencies(grid, tile)))
        z = [(values[2 * k] + 1j * values[2 * k + 1]) * r for k in range(len(names))]
        return [p for x in z for p in (x.real, x.imag)]

    there = t.map_tiles(forward(rows, grid, names), apply, pairs(names), pairs(names))
    return backward(there, grid, names).select(*KEY, *names)


def _frequencies(grid: Tiling, tile: int) -> list[np.ndarray]:
    """Angular frequencies along x, y and z of the voxels of a tile, each (z, y, x); beyond the grid they don't matter."""
    at = grid.coordinates(tile)
    return [2 * np.pi * at[a] / n for a, n in enumerate(grid.size)]


def fluid_kernel(fields: DataFrame, grid: Tiling, names: Sequence[str] = ("ux", "uy", "uz"), spacing: Sequence[float] = (1.0, 1.0, 1.0), alpha: float = 0.01, beta: float = 0.01, gamma: float = 0.001, inverse: bool = True) -> DataFrame:
    """L = -alpha laplacian - beta grad div + gamma, or its inverse, of tiled fields; a symmetric matrix at each frequency."""

    def apply(tile: int, values: list[np.ndarray]) -> list[np.ndarray]:
        w = [x.ravel() for x in _frequencies(grid, tile)]
        c = [(2 * np.cos(x) - 2) / s**2 for x, s in zip(w, spacing, strict=True)]
        d = [np.sin(x) / s for x, s in zip(w, spacing, strict=True)]
        m = np.zeros((len(w[0]), 3, 3))
        for i in range(3):
            for j in range(3):
                m[:, i, j] = gamma - alpha * (c[0] + c[1] + c[2]) - beta * c[i] if i == j else beta * d[i] * d[j]
        z = np.stack([values[2 * k] + 1j * values[2 * k + 1] for k in range(3)], 1)[..., None]
        z = (np.linalg.solve(m, z) if inverse else m @ z)[..., 0]
        return [p for k in range(3) for p in (z[:, k].real, z[:, k].imag)]

    there = t.map_tiles(forward(fields, grid, names), apply, pairs(names), pairs(names))
    return backward(there, grid, names).select(*KEY, *names)


def _padded(factor: int) -> Callable[[np.ndarray], np.ndarray]:
    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        f, more = np.fft.fft(x, axis=1), np.zeros((x.shape[0], n * (factor - 1), x.shape[2]))
        half = n - n // 2
        return np.fft.ifft(np.concatenate([f[:, :half], more, f[:, half:]], 1), axis=1) * factor

    return run


def sinc_upsample(rows: DataFrame, grid: Tiling, factor: int, names: Sequence[str] = ("v",)) -> tuple[DataFrame, Tiling]:
    """Real arrays on a grid of ``factor`` times as many voxels, by zeros at the high frequencies of each axis, and its tiling."""
    rows = with_imaginary(rows, names)
    for axis in range(3):
        out = Tiling(tuple(n * factor if a == axis else n for a, n in enumerate(grid.size)), grid.side)
        rows = along(rows, grid, axis, pairs(names), _complex(_padded(factor)), out)
        grid = out
    return rows.select(*KEY, *names), grid
