"""Pencils and solvers on tiles against numpy on whole volumes."""

import numpy as np
import pytest
from test_tiles import SIZE, images, long, whole

from volspark.operators import pencils, solvers, spectral, tiles
from volspark.operators.tiles import Tiling


@pytest.mark.parametrize("side", [2, 4])
def test_transform_there_and_back(spark, side):
    v, _ = images(1)
    grid = Tiling(SIZE, side)
    there = pencils.forward(tiles.tiled(long(spark, v), grid), grid)
    want = np.fft.fftn(v, axes=(1, 2, 3))
    found = tiles.untiled(there, grid, ("v", "v_i"))
    assert np.allclose(whole(found, v.shape), want.real) and np.allclose(whole(found, v.shape, "v_i"), want.imag)
    back = tiles.untiled(pencils.backward(there, grid), grid, ("v", "v_i"))
    assert np.allclose(whole(back, v.shape), v) and np.allclose(whole(back, v.shape, "v_i"), 0)


def test_convolution_and_operator(spark):
    v, p = images(2)
    grid = Tiling(SIZE, 3)
    response = spectral.gaussian_response(SIZE, (1.2,), (1.0,))
    blurred = pencils.convolve(tiles.tiled(long(spark, v), grid), grid, lambda w: np.exp(-sum(np.minimum(x, 2 * np.pi - x) ** 2 for x in w) * 1.2**2 / 2))
    assert np.allclose(whole(tiles.untiled(blurred, grid), v.shape), np.fft.ifftn(np.fft.fftn(v, axes=(1, 2, 3)) * response, axes=(1, 2, 3)).real)
    names = ("px", "py", "pz")
    field = tiles.tiled(long(spark, v, p), grid, names)
    for inverse in (True, False):
        want = spectral.apply_operator(p, SIZE, inverse=inverse)
        found = tiles.untiled(pencils.fluid_kernel(field, grid, names, inverse=inverse), grid, names)
        for k, n in enumerate(names):
            assert np.allclose(whole(found, v.shape, n), want[:, k])


@pytest.mark.parametrize("factor", [2, 3])
def test_sinc_upsample(spark, factor):
    v, _ = images(3)
    grid = Tiling(SIZE, 3)
    up, new = pencils.sinc_upsample(tiles.tiled(long(spark, v), grid), grid, factor)
    assert new.size == tuple(factor * n for n in SIZE)
    found = whole(tiles.untiled(up, new), (2, *[factor * n for n in SIZE[::-1]]))
    assert np.allclose(found[:, ::factor, ::factor, ::factor], v) and np.allclose(found, np.stack([spectral.sinc_upsample(x, factor) for x in v]))


def brute_sweeps(u, f, alpha, gamma, w, margin, sweeps):
    u, d = u.copy(), gamma + 6 * alpha
    n = u.shape[::-1]
    free = [(x, y, z) for z in range(margin, n[2] - margin) for y in range(margin, n[1] - margin) for x in range(margin, n[0] - margin)]
    around = lambda x, y, z: u[z, y, x - 1] + u[z, y, x + 1] + u[z, y - 1, x] + u[z, y + 1, x] + u[z - 1, y, x] + u[z + 1, y, x]
    norm = lambda: np.sqrt(sum((f[z, y, x] + alpha * around(x, y, z) - d * u[z, y, x]) ** 2 for x, y, z in free))
    out = [norm()]
    for _ in range(sweeps):
        for color in (0, 1):
            for x, y, z in free:
                if (x + y + z) % 2 == color:
                    u[z, y, x] += w * ((alpha * around(x, y, z) + f[z, y, x]) / d - u[z, y, x])
        out.append(norm())
    return u, out


@pytest.mark.parametrize(("side", "margin"), [(2, 1), (4, 1), (3, 2)])
def test_over_relaxation(spark, side, margin):
    v, p = images(4, size=(6, 5, 6))
    grid = Tiling((6, 5, 6), side)
    rows = tiles.tiled(long(spark, v, p), grid, ("v", "px")).withColumnsRenamed({"v": "u", "px": "f"})
    state, history = solvers.over_relaxation(rows, grid, 1.0, 0.1, 3, margin=margin)
    u = whole(tiles.untiled(state, grid, ("u",)), v.shape, "u")
    w = solvers.relaxation(grid.size)
    for i in range(2):
        want, norms = brute_sweeps(v[i], p[i, 0], 1.0, 0.1, w, margin, 3)
        assert np.allclose(u[i], want)
        assert np.allclose([r.residual for r in history.filter(f"image_id = {i}").orderBy("sweep").collect()], norms)


def test_over_relaxation_stops(spark):
    v, p = images(5, n=1, size=(5, 5, 5))
    grid = Tiling((5, 5, 5), 5)
    rows = tiles.tiled(long(spark, v, p), grid, ("v", "px")).withColumnsRenamed({"v": "u", "px": "f"})
    _, history = solvers.over_relaxation(rows, grid, sweeps=20, tolerance=0.2)
    norms = [r.residual for r in history.orderBy("sweep").collect()]
    assert len(norms) < 20 and norms[-1] <= 0.2 * norms[0] < norms[-2]


def test_conjugate_gradients_equal_the_transform(spark):
    v, _ = images(6, size=(6, 4, 4))
    grid = Tiling((6, 4, 4), 2)
    rows = tiles.tiled(long(spark, v), grid).withColumnRenamed("v", "f")
    u, history = solvers.conjugate_gradients(rows, grid, 0.05, 0.5, 8, 1e-5)
    k = np.meshgrid(*[2 * np.pi * np.arange(n) / n for n in v.shape[1:]], indexing="ij")
    response = 1 / (0.5 + 0.05 * sum(2 - 2 * np.cos(x) for x in k))
    want = np.fft.ifftn(np.fft.fftn(v, axes=(1, 2, 3)) * response, axes=(1, 2, 3)).real
    assert np.allclose(whole(tiles.untiled(u, grid, ("u",)), v.shape, "u"), want, atol=1e-4)
    norms = [r.residual for r in history.filter("image_id = 0").orderBy("step").collect()]
    assert norms[-1] <= 1e-5 * norms[0]
    zero, _ = solvers.conjugate_gradients(tiles.tiled(long(spark, 0 * v), grid).withColumnRenamed("v", "f"), grid, steps=1)
    assert np.allclose(whole(tiles.untiled(zero, grid, ("u",)), v.shape, "u"), 0)
    open_grid = Tiling((6, 4, 4), 4)
    u, _ = solvers.conjugate_gradients(tiles.tiled(long(spark, v), open_grid).withColumnRenamed("v", "f"), open_grid, 0.05, 0.5, 8, 1e-5, periodic=False)
    x = whole(tiles.untiled(u, open_grid, ("u",)), v.shape, "u")
    around = np.pad(x, [(0, 0), *[(1, 1)] * 3])
    lap = sum(np.roll(around, s, a) for a in (1, 2, 3) for s in (-1, 1))[:, 1:-1, 1:-1, 1:-1]
    assert np.allclose((0.5 + 0.3) * x - 0.05 * lap, v, atol=1e-3)


def test_a_sweep_exchanges_borders_twice(spark, monkeypatch):
    """The residual before a sweep comes from the borders of its first half."""
    made, parts = [], tiles._parts
    monkeypatch.setattr(tiles, "_parts", lambda *a, **k: made.append(a) or parts(*a, **k))
    v, p = images(7, n=1)
    grid = Tiling(SIZE, 3)
    rows = tiles.tiled(long(spark, v, p), grid, ("v", "px")).withColumnsRenamed({"v": "u", "px": "f"})
    _, history = solvers.over_relaxation(rows, grid, 1.0, 0.1, 3)
    assert np.allclose([r.residual for r in history.orderBy("sweep").collect()], brute_sweeps(v[0], p[0, 0], 1.0, 0.1, solvers.relaxation(SIZE), 1, 3)[1])
    assert len(made) == 7
