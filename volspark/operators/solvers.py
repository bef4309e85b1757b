"""Solvers of (gamma - alpha laplacian) u = f on tiled volumes.

Both keep their state in tiles and exchange borders between steps; what a step
needs to know of the whole image (residuals, dot products) is a sum by image,
partial in each task. The state is cut after each sweep or step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators import tiles as t
from volspark.operators.tiles import KEY, Tiling
from volspark.plans.state import cut

#: Images whose scalars are broadcast; more are joined by shuffle.
SMALL = 100_000


def relaxation(size: Sequence[int]) -> float:
    """The over-relaxation of the model problem on a grid of this size."""
    p = sum(math.cos(math.pi / (n - 1)) for n in size if n > 1) / 3
    return 2 / (1 + math.sqrt(max(0.0, 1 - p * p)))


def _around(block: np.ndarray) -> np.ndarray:
    """The sum of the six neighbours of each inner voxel of blocks (..., z, y, x) with borders of one."""
    inner = slice(1, -1)
    return (
        block[..., :-2, inner, inner] + block[..., 2:, inner, inner] + block[..., inner, :-2, inner]
        + block[..., inner, 2:, inner] + block[..., inner, inner, :-2] + block[..., inner, inner, 2:]
    )


def _free(grid: Tiling, tile: int | np.ndarray, margin: int) -> np.ndarray:
    """Whether the voxels of a tile, or of tiles, are ``margin`` voxels or more from the border of the grid."""
    at = grid.coordinates(tile)
    return np.logical_and.reduce([(at[a] >= margin) & (at[a] < n - margin) for a, n in enumerate(grid.size)])


def over_relaxation(rows: DataFrame, grid: Tiling, alpha: float = 1.0, gamma: float = 0.0, sweeps: int = 100, omega: float | None = None, margin: int = 1, tolerance: float = 0.0, value: str = "u", force: str = "f") -> tuple[DataFrame, DataFrame]:
    """Red-black sweeps: tiles (image_id, tile, u, f) and the history (image_id, sweep, residual) of the norm of f - L u.

    Voxels within ``margin`` of the border keep their values. A sweep updates the
    voxels whose x + y + z is even, then the others, each from its six neighbours.
    Sweeps end after ``sweeps``, or when no image's residual is above ``tolerance``
    times its first.
    """
    w = relaxation(grid.size) if omega is None else omega
    diagonal = gamma + 6 * alpha
    names = (value, force)

    def parts(block: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """u with its borders, u and f."""
        return block[:, 0], block[:, 0, 1:-1, 1:-1, 1:-1], rest[:, 0].reshape(-1, grid.side, grid.side, grid.side)

    def half(color: int):
        def update(tile: np.ndarray, block: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
            wide, u, f = parts(block, rest)
            turn = _free(grid, tile, margin) & (grid.coordinates(tile).sum(0) % 2 == color)
            out = [np.where(turn, u + w * ((alpha * _around(wide) + f) / diagonal - u), u), f]
            # The borders of a sweep's first half also give the residual before it.
            return out if color else [*out, *residual(tile, block, rest)]

        return update

    def residual(tile: np.ndarray, block: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        wide, u, f = parts(block, rest)
        r = np.where(_free(grid, tile, margin), f + alpha * _around(wide) - diagonal * u, 0.0)
        return [(r**2).sum((1, 2, 3))]

    def measured(sums: DataFrame, sweep: int) -> DataFrame:
        return cut(sums.groupBy("image_id").agg(F.sqrt(F.sum(F.get("r", F.lit(0)))).alias("residual")).select("image_id", F.lit(sweep).alias("sweep"), "residual"))

    def done(last: DataFrame, first: DataFrame) -> bool:
        both = last.join(first.select("image_id", F.col("residual").alias("start")), "image_id")
        return both.filter(F.col("residual") > tolerance * F.col("start")).isEmpty()

    state = t._typed(rows, names)
    history = first = None
    for sweep in range(sweeps + 1):
        if sweep == sweeps:
            state = cut(state)
            last = measured(t.map_haloed(state, grid, residual, [value], [force], ["r"]), sweep)
        else:
            turned = cut(t.map_haloed(state, grid, half(0), [value], [force], [*names, "r"]))
            last = measured(turned, sweep)
        history, first = (last, last) if history is None else (history.unionByName(last), first)
        if sweep == sweeps or (sweep and tolerance > 0 and done(last, first)):
            break
        state = t.map_haloed(turned, grid, half(1), [value], [force], names)
    return state, history


def _by_image(state: DataFrame, scalars: DataFrame) -> DataFrame:
    """Rows of tiles with the scalars of their image, broadcast if they are counted to be few."""
    return state.join(F.broadcast(scalars) if scalars.limit(SMALL + 1).count() <= SMALL else scalars, "image_id")


def conjugate_gradients(rows: DataFrame, grid: Tiling, alpha: float = 0.01, gamma: float = 0.001, steps: int = 50, tolerance: float = 1e-8, periodic: bool = True, force: str = "f") -> tuple[DataFrame, DataFrame]:
    """Tiles (image_id, tile, u) and the history (image_id, step, residual), from u = 0 and tiles (image_id, tile, f).

    The operator is never a matrix: a step exchanges the borders of the direction
    and applies the stencil; its two dot products are sums by image. Beyond the
    grid is 0, or the periodic neighbour. gamma must be positive where the grid is
    periodic. An image whose residual is 0 stays as it is.
    """

    def applied(tile: np.ndarray, block: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        p = block[:, 0]
        inner = p[:, 1:-1, 1:-1, 1:-1]
        q = np.where(grid.within(grid.coordinates(tile)), (gamma + 6 * alpha) * inner - alpha * _around(p), 0.0)
        pq = (inner * q).sum((1, 2, 3))
        return [rest[:, 0], rest[:, 1], inner, q, pq]

    def cleared(tile: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        f = np.where(grid.within(grid.coordinates(tile)).reshape(len(tile), -1), values[0], 0.0)
        return [np.zeros_like(f), f, f, (f**2).sum(1)]

    def stepped(tile: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        u, r, p, q, a = values
        r = r - a * q
        return [u + a * p, r, p, (r**2).sum(1)]

    total = lambda c: F.sum(F.get(c, F.lit(0)))
    state = cut(t.map_stacks(rows, cleared, [force], ["u", "r", "p", "rr"]))
    squares = cut(state.groupBy("image_id").agg(total("rr").alias("rr")))
    history = squares.select("image_id", F.lit(0).alias("step"), F.sqrt("rr").alias("residual"))
    first = squares.select("image_id", F.col("rr").alias("start"))
    for step in range(1, steps + 1):
        state = cut(t.map_haloed(state, grid, applied, ["p"], ["u", "r"], ["u", "r", "p", "q", "pq"], wrap=periodic))
        length = state.groupBy("image_id").agg(total("pq").alias("pq")).join(squares, "image_id")
        length = cut(length.select("image_id", F.array(F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0)).alias("a")))
        state = cut(t.map_stacks(_by_image(state.drop("pq"), length), stepped, ["u", "r", "p", "q", "a"], ["u", "r", "p", "rr"]))
        after = cut(state.groupBy("image_id").agg(total("rr").alias("rr")))
        history = history.unionByName(after.select("image_id", F.lit(step).alias("step"), F.sqrt("rr").alias("residual")))
        if step == steps or after.join(first, "image_id").filter(F.col("rr") > tolerance**2 * F.col("start")).isEmpty():
            break
        ratio = cut(after.join(squares.withColumnRenamed("rr", "old"), "image_id").select("image_id", F.array(F.when(F.col("old") > 0, F.col("rr") / F.col("old")).otherwise(0.0)).alias("c")))
        state = t.map_stacks(_by_image(state.drop("rr"), ratio), lambda tile, v: [v[0], v[1], v[1] + v[3] * v[2]], ["u", "r", "p", "c"], ["u", "r", "p"])
        squares = after
    return state.select(*KEY, "u"), history
