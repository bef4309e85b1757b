"""Principal images and chains of transforms against numpy, with several pieces and tiles an image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.operators import chains, components, kernels, tiles
from volspark.operators.chains import Affine, Field
from volspark.operators.fields import U
from volspark.operators.interp import PLACE
from volspark.operators.tiles import Tiling

SIZE = (5, 4, 3)
STEPS = [Affine((0.9, 0.1, 0.0, -0.1, 0.9, 0.0, 0.0, 0.0, 1.0), (0.3, 0.2, -0.1)), Field(), Affine(shift=(0.4, 0.0, -0.2))]


@pytest.mark.parametrize("limit", [components.BROADCAST, 0])
def test_principal_images(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "BROADCAST", limit)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 3)) @ np.diag([9.0, 3.0, 1.0]) @ np.linalg.qr(rng.normal(size=(17, 3)))[0].T + 2.0
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [])], "image_id long, data array<double>")
    found = components.principal_images(images, 4, 25, width=5)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    assert np.allclose(found.values[:3], values[::-1][:3], rtol=1e-6)
    assert found.values[3] < 1e-6
    got = np.zeros((4, 17))
    for r in components.component_images(found).collect():
        got[r.k, r.i] = r.c
    assert np.allclose(abs((got[:3] * vectors[:, ::-1].T[:3]).sum(1)), 1, atol=1e-6)
    rows = components.projections(images, found).collect()
    assert {r.image_id for r in rows} == set(range(9))
    assert np.allclose([r.error for r in rows if r.k == 2], 0, atol=1e-6)
    back = np.zeros_like(x)
    for r in components.rebuilt(images, found).collect():
        back[r.image_id, r.block * 5 : r.block * 5 + len(r.data)] = r.data
    assert np.allclose(back, x, atol=1e-6)


def test_no_images(spark):
    none = spark.createDataFrame([], "image_id long, data array<double>")
    found = components.principal_images(none, 2, 2)
    assert found.values == [0.0, 0.0]
    assert components.component_images(found).count() == components.projections(none, found).count() == 0


def _walk(p, u, steps):
    for s in steps:
        if isinstance(s, Affine):
            m, t = s.numbers()
            p = np.einsum("ij,j...->i...", np.reshape(m, (3, 3)), p) + np.reshape(t, (3, *[1] * (p.ndim - 1)))
        else:
            base = p
            for _ in range(s.iterations if s.inverse else 1):
                p = base + (-1 if s.inverse else 1) * kernels.sample(u[None], p[None], "clamp")[0]
    return p


def test_chain_of_tiles_and_points(spark):
    rng = np.random.default_rng(5)
    u, v = rng.uniform(-0.3, 0.3, size=(3, *SIZE[::-1])), rng.normal(size=SIZE[::-1])
    x = kernels.identity(SIZE)
    rows = spark.createDataFrame([(7, i, j, k, float(v[k, j, i]), *map(float, u[:, k, j, i])) for k in range(3) for j in range(4) for i in range(5)], "image_id long, x int, y int, z int, v double, ux double, uy double, uz double")
    grid = Tiling(SIZE, 3)
    t = tiles.tiled(rows, grid, ("v", *U))
    want = kernels.sample(v[None, None], _walk(x, u, STEPS)[None], "value", 0.0)[0, 0]
    got = np.zeros_like(v)
    for r in tiles.untiled(chains.apply(t, t, STEPS, grid), grid).collect():
        got[r.z, r.y, r.x] = r.v
    assert np.allclose(got, want)
    steps = [*STEPS, *chains.inverted(STEPS)]
    places = _walk(x, u, steps).reshape(3, -1).T
    p = spark.createDataFrame([(7, n, *map(float, c)) for n, c in enumerate(x.reshape(3, -1).T)] + [(8, 0, 1.0, 1.0, 1.0), (7, 1000, None, 1.0, 1.0)], "image_id long, point_id long, px double, py double, pz double")
    found = {(r.image_id, r.point_id): r for r in chains.points_through(p, rows, steps, SIZE).collect()}
    assert np.allclose([[found[7, n][c] for c in PLACE] for n in range(len(places))], places)
    # Places within the grid come back; a field's inverse is only that of its nearest voxel beyond it.
    assert np.median(abs(places - x.reshape(3, -1).T)) < 1e-3
    assert found[8, 0].px is None and found[7, 1000].px is None
    with pytest.raises(ValueError):
        chains.points_through(p, None, STEPS, SIZE)
    assert chains.points_through(p.filter(F.lit(False)), rows, STEPS, SIZE).count() == 0


@pytest.mark.parametrize("limit", [chains.BROADCAST, 0])
def test_points_stay_one_row_each(spark, monkeypatch, limit):
    """Cubes smaller than the grid, sent to all tasks or joined by parts; a voxel that isn't there counts as 0."""
    monkeypatch.setattr(chains, "BROADCAST", limit)
    monkeypatch.setattr(chains, "SIDE", 2)
    monkeypatch.setattr(chains, "PART", 10)
    rng = np.random.default_rng(8)
    u = rng.uniform(-0.3, 0.3, size=(3, *SIZE[::-1]))
    u[:, 1, 2, 3] = 0
    fields = spark.createDataFrame([(7, i, j, k, *map(float, u[:, k, j, i])) for k in range(3) for j in range(4) for i in range(5) if (k, j, i) != (1, 2, 3)], "image_id long, x int, y int, z int, ux double, uy double, uz double")
    start = rng.uniform(-0.5, 4.5, size=(3, 50))
    steps = [*STEPS, Field(inverse=True, iterations=3)]
    p = spark.createDataFrame([(7, n, *map(float, c)) for n, c in enumerate(start.T)], "image_id long, point_id long, px double, py double, pz double")
    out = chains.points_through(p, fields, steps, SIZE)
    found = {r.point_id: [r[c] for c in PLACE] for r in out.collect()}
    assert np.allclose([found[n] for n in range(50)], _walk(start, u, steps).T)
    # No row a corner: nothing is exploded or summed by point on the way.
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_borders_of_a_field_are_exchanged_once(spark, monkeypatch):
    """Look-ups of one field share its blocks, and carry their base along instead of joining it."""
    made, blocks = [], tiles.blocks
    monkeypatch.setattr(tiles, "blocks", lambda *a, **k: made.append(a) or blocks(*a, **k))
    rng = np.random.default_rng(9)
    u = rng.uniform(-0.3, 0.3, size=(3, *SIZE[::-1]))
    grid = Tiling(SIZE, 2)
    images = spark.createDataFrame([(7, *[u[k].ravel().tolist() for k in range(3)])], "image_id long, ux array<double>, uy array<double>, uz array<double>")
    t = tiles.of_images(images, grid, U)
    steps = [Field(inverse=True, iterations=3), Affine(shift=(0.2, 0.0, 0.1)), Field()]
    want, got = _walk(kernels.identity(SIZE), u, steps), np.full((3, *SIZE[::-1]), np.nan)
    for r in tiles.untiled(chains.places(t, t, steps, grid), grid, PLACE).collect():
        got[:, r.z, r.y, r.x] = [r[c] for c in PLACE]
    assert np.allclose(got, want) and len(made) == 1


def test_inverse_takes_all_iterations():
    """The way back of the query isn't cut short of what Field takes."""
    from volspark.plans import composed

    assert composed.INVERSE == chains.inverted(composed.CHAIN)
    assert [s.iterations for s in composed.INVERSE if isinstance(s, Field)] == [Field().iterations] * 2 == [10, 10]


@pytest.mark.parametrize("side", [2, 5])
def test_iterations_stay_in_their_tile(spark, monkeypatch, side):
    """Iterations don't exchange places that stay in their tile: one round where an image is one tile, else as many as places leave tiles."""
    rounds, met = [], tiles._met
    monkeypatch.setattr(tiles, "_met", lambda *a: rounds.append(a) or met(*a))
    rng = np.random.default_rng(10)
    u, v = rng.uniform(-0.9, 0.9, size=(2, 3, *SIZE[::-1]))
    grid = Tiling(SIZE, side)
    rows = [(i, *[w[k].ravel().tolist() for k in range(3)]) for i, w in ((7, u), (8, v))]
    t = tiles.of_images(spark.createDataFrame(rows, "image_id long, ux array<double>, uy array<double>, uz array<double>"), grid, U)
    # A tile without a row counts as a field of 0.
    held = t.filter(~((F.col("image_id") == 8) & (F.col("tile") == 1)))
    lost = tiles.untiled(held, grid, U).filter("image_id = 8").collect()
    w = np.zeros_like(v)
    for r in lost:
        w[:, r.z, r.y, r.x] = [r[c] for c in U]
    steps = [Affine(shift=(0.2, -1.3, 0.1)), Field(inverse=True)]
    got = {i: np.full((3, *SIZE[::-1]), np.nan) for i in (7, 8)}
    for r in tiles.untiled(chains.places(t, held, steps, grid), grid, PLACE).collect():
        got[r.image_id][:, r.z, r.y, r.x] = [r[c] for c in PLACE]
    for i, field in ((7, u), (8, w)):
        assert np.allclose(got[i], _walk(kernels.identity(SIZE), field, steps), atol=1e-6)
    assert len(rounds) == 1 if side == 5 else 1 < len(rounds) <= 10
