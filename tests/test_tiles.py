"""Tiled volumes against the kernels of whole volumes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volspark.operators import kernels, tiles
from volspark.operators.interp import PLACE
from volspark.operators.tiles import Tiling

SIZE = (6, 5, 4)


def images(seed, n=2, names=("v", *PLACE), size=SIZE):
    rng = np.random.default_rng(seed)
    x = kernels.identity(size)
    v = rng.normal(size=(n, *size[::-1]))
    p = x + rng.normal(scale=2.5, size=(n, 3, *size[::-1]))
    return v, p


def long(spark, v, p=None):
    """Voxels of stacks, (image_id, x, y, z, v and places)."""
    b, sz, sy, sx = v.shape
    rows = []
    for i in range(b):
        for z in range(sz):
            for y in range(sy):
                for x in range(sx):
                    at = [] if p is None else [float(c) for c in p[i, :, z, y, x]]
                    rows.append((i, x, y, z, float(v[i, z, y, x]), *at))
    return spark.createDataFrame(rows, "image_id long, x int, y int, z int, v double" + ("" if p is None else ", px double, py double, pz double"))


def whole(rows, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        out[r.image_id, r.z, r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("side", [1, 3, 4, 8])
def test_round_trip_and_borders(spark, side):
    v, _ = images(1)
    grid = Tiling(SIZE, side)
    t = tiles.tiled(long(spark, v), grid)
    assert np.array_equal(whole(tiles.untiled(t, grid), v.shape), v)
    block = tiles.haloed(t, grid, fill=7.0)
    padded = np.pad(v, [(0, 0), *[(1, side + 1)] * 3], constant_values=7.0)
    for r in block.collect():
        x, y, z = grid.corner(r.tile)
        w = side + 2
        assert np.array_equal(np.reshape(r.v, (w, w, w)), padded[r.image_id, z : z + w, y : y + w, x : x + w])


@pytest.mark.parametrize(("side", "strategy"), [(2, "value"), (3, "clamp"), (4, "value"), (8, "clamp")])
def test_gather_is_the_warp_of_whole_volumes(spark, side, strategy):
    v, p = images(2)
    grid = Tiling(SIZE, side)
    t = tiles.tiled(long(spark, v, p), grid, ("v", *PLACE))
    got = tiles.gather(t, t, grid, strategy=strategy, background=0.5)
    assert np.allclose(whole(tiles.untiled(got, grid), v.shape), kernels.sample(v[:, None], p, strategy, 0.5)[:, 0])


def test_periodic_gather_and_scatter(spark):
    size = (6, 4, 2)
    v, p = images(3, size=size)
    grid = Tiling(size, 2)
    t = tiles.tiled(long(spark, v, p), grid, ("v", *PLACE))
    assert np.allclose(whole(tiles.untiled(tiles.gather(t, t, grid, strategy="wrap"), grid), v.shape), kernels.sample(v[:, None], p, "wrap")[:, 0])
    assert np.allclose(whole(tiles.untiled(tiles.splat(t, grid, wrap=True), grid), v.shape), kernels.scatter(v, p, size, True)[0], equal_nan=True)
    with pytest.raises(ValueError, match="divides"):
        tiles.gather(t, t, Tiling(size, 4), strategy="wrap")


@pytest.mark.parametrize("normalize", [False, True])
def test_scatter_is_the_splat_of_whole_volumes(spark, normalize):
    v, p = images(4)
    grid = Tiling(SIZE, 3)
    t = tiles.tiled(long(spark, v, p), grid, ("v", *PLACE))
    sums, mass = kernels.scatter(v, p, SIZE)
    want = np.where(mass > 0, sums / np.where(mass > 0, mass, 1), np.where(np.isnan(mass), np.nan, 0.25)) if normalize else sums
    assert np.allclose(whole(tiles.untiled(tiles.splat(t, grid, normalize=normalize, background=0.25), grid), v.shape), want, equal_nan=True)


def test_all_places_in_one_tile(spark, monkeypatch):
    """Requests and sums of a hot tile are dealt over several parts."""
    monkeypatch.setattr(tiles, "REQUESTS", 3)
    v, p = images(5)
    p = 1.2 + 0.1 * np.tanh(p)
    grid = Tiling(SIZE, 2)
    t = tiles.tiled(long(spark, v, p), grid, ("v", *PLACE))
    assert np.allclose(whole(tiles.untiled(tiles.gather(t, t, grid), grid), v.shape), kernels.sample(v[:, None], p)[:, 0])
    assert np.allclose(whole(tiles.untiled(tiles.splat(t, grid), grid), v.shape), kernels.scatter(v, p, SIZE)[0], equal_nan=True)


def test_region_and_missing_tiles(spark):
    v, p = images(6)
    p[0, 0, 0, 0, 0] = np.nan
    grid = Tiling(SIZE, 2)
    t = tiles.tiled(long(spark, v, p), grid, ("v", *PLACE))
    low, high = (1, 0, 1), (4, 3, 3)
    got = whole(tiles.untiled(tiles.gather(t, t, grid, roi=(low, high)), grid), v.shape)
    want = kernels.sample(v[:, None], p)[:, 0]
    inside = (slice(None), slice(1, 3), slice(0, 3), slice(1, 4))
    assert np.allclose(got[inside], want[inside]) and np.nansum(np.abs(got)) == pytest.approx(np.abs(want[inside]).sum())
    holes = tiles.gather(t.filter("tile <> 3"), t, grid)
    kept = v.copy()
    x, y, z = grid.corner(3)
    kept[:, z : z + 2, y : y + 2, x : x + 2] = 0
    assert np.allclose(whole(tiles.untiled(holes, grid), v.shape), kernels.sample(kept[:, None], p)[:, 0])
    assert tiles.gather(t.limit(0), t.limit(0), grid).count() == 0 and tiles.splat(t.limit(0), grid).count() == 0


def test_positions(spark):
    values = spark.createDataFrame([(1, i, float(i * i)) for i in range(5)], "image_id long, i long, v double")
    asked = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (1, 2, 9)], "image_id long, i long, p long")
    assert {r.i: r.v for r in tiles.at_positions(values, asked).collect()} == {0: 16.0, 1: 16.0, 2: None}
    moved = values.select("image_id", F.pmod(F.col("i") + 2, F.lit(5)).alias("p"), "v")
    assert {r.i: r.v for r in tiles.to_positions(moved).collect()} == {2: 0.0, 3: 1.0, 4: 4.0, 0: 9.0, 1: 16.0}


@pytest.mark.parametrize("size", [1, tiles.PIECE])
def test_stacks_go_on_over_pieces(monkeypatch, size):
    """Blocks, answers and values of tiles whose rows come in several pieces, and of many tiles in one."""
    monkeypatch.setattr(tiles, "PIECE", size)
    v, p = images(7, n=3)
    grid, side = Tiling(SIZE, 3), 3
    keys, rows = [], []
    for image in range(3):
        for tile in range(8):
            x, y, z = grid.corner(tile)
            pad = lambda a: np.pad(a, [(0, 3), (0, 3), (0, 3)])[z : z + side, y : y + side, x : x + side].ravel()  # noqa: E731, B023
            keys.append((image, tile))
            rows.append([pad(a) for a in (v[image], *p[image])])
    images_, tiles_ = np.array(keys).T
    batch = tiles._out(images_, tiles_, [np.stack([r[k] for r in rows]) for k in range(4)], ["v", *PLACE])
    by = lambda batches, *names: [pa.Table.from_batches(batches).sort_by([(n, "ascending") for n in names]).combine_chunks().to_batches()[0]]
    parts = by(list(tiles._borders([batch.select([0, 1, 2])], grid, 1, 0, 1, False, False)), "image_id", "tile")
    asked = list(tiles._ask([batch.select([0, 1, 3, 4, 5])], grid, grid, "value", None, 0))
    found = list(tiles._blocks(parts, grid, 1, 0, 0, 1, 0.0, False, True))
    assert sum(len(t) for _, t, _, _ in found) == 24 and (size == 1 or max(len(t) for _, t, _, _ in found) > 8)
    schema = pa.schema([*[(n, pa.int64()) for n in ("image_id", "tile", "salt", "to")], *[(n, pa.binary()) for n in ("i", "p", "data")]])
    held = [(int(i), int(t), 0, None, None, None, b.tobytes()) for image, tile, block, _ in found for i, t, b in zip(image, tile, block, strict=True)]
    held += [(r["image_id"], r["tile"], 0, r["to"], r["i"], r["p"], None) for b in asked for r in b.to_pylist()]
    held.sort(key=lambda r: (*r[:3], r[-1] is None))
    mixed = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    replies = by(list(tiles._answers([mixed], grid, 1, 0.0)), "image_id", "tile")
    want = kernels.sample(v[:, None], p)[:, 0]
    for image, tile, values, _ in tiles._gathered(replies, grid, 1, 0.0, False):
        for i, t, got in zip(image, tile, values[:, 0], strict=True):
            x, y, z = grid.corner(t)
            inside = want[i, z : z + side, y : y + side, x : x + side]
            assert np.allclose(got.reshape(side, side, side)[: inside.shape[0], : inside.shape[1], : inside.shape[2]], inside)


def test_tiles_of_whole_images(spark):
    v, _ = images(8)
    grid = Tiling(SIZE, 3)
    rows = spark.createDataFrame([(i, [None, *map(float, x.ravel()[1:])]) for i, x in enumerate(v)] + [(9, None)], "image_id long, v array<double>")
    v[:, 0, 0, 0] = 0
    cut_up, by_voxel = (sorted(map(tuple, t.collect())) for t in (tiles.of_images(rows, grid), tiles.tiled(long(spark, v), grid)))
    assert cut_up == by_voxel


def test_stencil_of_many_tiles_a_call(spark):
    """Carried arrays need no borders, and a call has more than one tile."""
    v, p = images(9)
    grid = Tiling(SIZE, 2)
    rows = tiles.tiled(long(spark, v, p), grid, ("v", "px")).coalesce(1)
    found = tiles.map_haloed(rows, grid, lambda t, block, rest: [block[:, 0, 1:-1, 1:-1, 2:], rest[:, 0], np.full(len(t), len(t))], ["v"], ["px"], ["v", "px", "n"])
    assert max(r.n[0] for r in found.collect()) > 1
    assert np.array_equal(whole(tiles.untiled(found, grid, ("v",)), v.shape)[..., :-1], v[..., 1:])
    assert np.array_equal(whole(tiles.untiled(found, grid, ("px",)), v.shape, "px"), p[:, 0])
