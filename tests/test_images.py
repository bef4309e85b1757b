"""Whole-image operators against plain numpy, and the files they are read from and written to."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark import cli
from volspark.config import AtlasParams, GreedyParams, LDMMParams, Level
from volspark.operators import fields, interp, kernels, preprocess, registration, shapes, spectral, surface
from volspark.sources import catalogue, volume_files

SIZE = (4, 5, 3)


def ball(centre, radius, n=12):
    x = kernels.identity((n, n, n))
    return 1 / (1 + np.exp(np.sqrt(((x - centre) ** 2).sum(0)) - radius))


def images(spark, *arrays, name="data"):
    return spark.createDataFrame([(i, np.ravel(a).tolist()) for i, a in enumerate(arrays)], f"image_id long, {name} array<double>")


def field_rows(spark, *stacks, names=fields.H):
    return spark.createDataFrame([(i, *[c.ravel().tolist() for c in s]) for i, s in enumerate(stacks)], "image_id long, " + ", ".join(f"{n} array<double>" for n in names))


def as_field(row, size, names=fields.H):
    return np.stack([np.array(row[n]).reshape(size[::-1]) for n in names])


def test_warp_by_hand_with_odd_places(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=SIZE[::-1])
    p = kernels.identity(SIZE) + rng.normal(size=(3, *SIZE[::-1]))
    p[:, 0, 0, 0], p[:, 0, 0, 1] = np.nan, np.inf
    rows = images(spark, v).join(field_rows(spark, p, names=interp.PLACE), "image_id")
    got = np.array(interp.warp(rows, SIZE).first()["data"]).reshape(SIZE[::-1])
    for z, y, x in np.ndindex(*SIZE[::-1]):
        want, at = 0.0, p[:, z, y, x]
        if np.isfinite(at).all():
            low = np.floor(at).astype(int)
            for corner in np.ndindex(2, 2, 2):
                i = low + corner
                if ((i >= 0) & (i < SIZE)).all():
                    want += np.prod(np.where(corner, at - low, 1 - (at - low))) * v[i[2], i[1], i[0]]
        assert got[z, y, x] == pytest.approx(want)
    assert interp.warp(rows.withColumn("data", F.lit(None).cast("array<double>")), SIZE).count() == 0
    assert interp.warp(rows.limit(0), SIZE).count() == 0


def test_resized_fields_keep_affine_places(spark):
    h = kernels.identity((9, 9, 9)) * 0.5 + 2
    (row,) = fields.resample(field_rows(spark, h), (9, 9, 9), (5, 5, 5)).collect()
    assert np.allclose(as_field(row, (5, 5, 5)), kernels.identity((5, 5, 5)) * 0.5 + 1)


def test_points_are_inverted(spark):
    size = (8, 8, 8)
    h = kernels.identity(size) * 0.9 + 0.3
    want = np.array([[2.2, 3.1, 4.0], [5.0, 1.5, 2.5]])
    points = spark.createDataFrame([(0, k, *map(float, p * 0.9 + 0.3)) for k, p in enumerate(want)] + [(0, 9, 90.0, 90.0, 90.0)], "image_id long, point_id long, px double, py double, pz double")
    got = {r["point_id"]: (r["x"], r["y"], r["z"]) for r in fields.inverse_of_points(field_rows(spark, h), points, size).collect()}
    assert np.allclose([got[0], got[1]], want) and got[9] == (None, None, None)


def test_multi_gaussian_and_recursive_blur_keep_the_mean(spark):
    v = np.random.default_rng(2).normal(size=(3, 8, 8, 8))
    out = as_field(spectral.multi_gaussian(field_rows(spark, v, names=fields.U), (8, 8, 8), (1.0, 2.0), (1.0, 3.0)).first(), (8, 8, 8), fields.U)
    assert np.allclose(out.mean((1, 2, 3)), v.mean((1, 2, 3))) and out.std() < v.std()
    flat = np.array(spectral.recursive_blur(images(spark, np.ones((8, 8, 8))), (8, 8, 8), (1.0, 1.0, 1.0)).first()["data"])
    assert np.allclose(flat, 1)
    up = np.array(interp.sinc_upsample(images(spark, v[0]), (8, 8, 8), 2).first()["data"]).reshape(16, 16, 16)
    assert np.allclose(up[::2, ::2, ::2], v[0])


@pytest.mark.parametrize(("method", "params"), [("greedy", GreedyParams(iterations=6)), ("relaxation", LDMMParams(iterations=6, reparameterise=3, auto_reduce=True)), ("shooting", LDMMParams(iterations=6))])
def test_pyramids_lower_the_energy(spark, method, params):
    a, b = ball(5.5, 3.0), ball(5.5, 4.0)
    pairs = spark.createDataFrame([(k, a.ravel().tolist(), b.ravel().tolist()) for k in (1, 2)], "pair_id long, moving array<double>, fixed array<double>")
    out = registration.register(pairs, (12, 12, 12), method, params, (Level(2, 8), Level(1)))
    rows = out.collect()
    assert rows[0]["scale"] == [2] * 8 + [1] * 6 and np.allclose(rows[0]["energy"], rows[1]["energy"])
    assert rows[0]["energy"][7] < rows[0]["energy"][0] and ((np.array(rows[0]["data"]) - b.ravel()) ** 2).sum() < ((a - b) ** 2).sum()
    events = registration.energy_events(out).filter("pair_id = 1").orderBy("iter").collect()
    assert [e["change"] is None for e in events] == [k in (0, 8) for k in range(14)]


def test_velocities_of_constant_speed():
    vs = np.zeros((1, 4, 3, 2, 2, 2))
    vs[0, 0, 0], vs[0, 3, 0] = 3.0, 1.0
    out = registration.reparameterise(vs)
    assert np.allclose(out.sum(1), vs.sum(1)) and np.allclose(out[0, :, 0], 1.0)
    assert not registration.reparameterise(np.zeros_like(vs)).any()


@pytest.mark.parametrize("atlas", [AtlasParams(), AtlasParams(median=True), AtlasParams(trimmed_size=2), AtlasParams(voxel_median=True), AtlasParams(jacobian_scale=False)])
def test_ldmm_atlas(spark, atlas):
    rows = [(0, i, 1.0, ball(c, 3.0, 8).ravel().tolist()) for i, c in enumerate((3.0, 3.5, 4.0))]
    cohort = spark.createDataFrame(rows, "cohort int, image_id long, w double, data array<double>")
    mean, state = registration.build_atlas(cohort, (8, 8, 8), LDMMParams(iterations=4, sigma=1.0), atlas, (Level(2, 1), Level(1)))
    found = np.array(mean.first()["mean"])
    assert len(found) == 512 and np.isfinite(found).all() and state.count() == 3
    if atlas == AtlasParams():
        energy = [registration.build_atlas(cohort, (8, 8, 8), LDMMParams(iterations=k, sigma=1.0), atlas)[1].agg(F.sum("energy")).first()[0] for k in (1, 6)]
        assert energy[1] < energy[0]


def test_affine_atlas_aligns(spark):
    rows = [(0, i, 1.0, ball(c, 3.0, 8).ravel().tolist()) for i, c in enumerate((3.0, 3.5, 4.0))]
    cohort = spark.createDataFrame(rows, "cohort int, image_id long, w double, data array<double>")
    _, state = registration.affine_atlas(cohort, (8, 8, 8), "translation", 3)
    moved = [np.array(r["deformed"]) for r in state.collect()]
    assert max(np.abs(m - moved[0]).max() for m in moved) < 0.5 * np.abs(np.array(rows[0][3]) - rows[2][3]).max()


def test_preparation(spark):
    v = np.random.default_rng(3).normal(size=(6, 6, 6))
    out = np.array(preprocess.preprocess(images(spark, v, np.ones((6, 6, 6))), (6, 6, 6), preprocess.PreprocessParams(tukey_width=0, window=(-1.0, 1.0))).first()["data"])
    assert np.allclose(out, (np.clip(v, -1, 1).ravel() + 1) / 2)
    headers = spark.createDataFrame([(1, [6, 6, 6], [0.0] * 3, [1.0] * 3), (2, [6, 6, 6], [0.0] * 3, [1.0, 1.0, 1.5]), (3, None, [0.0] * 3, [1.0] * 3)], "image_id long, size array<int>, origin array<double>, spacing array<double>")
    assert {r["image_id"] for r in preprocess.incongruent(headers, (6, 6, 6), (0, 0, 0), (1, 1, 1)).collect()} == {2, 3}


def test_vector_and_slice_files(spark, tmp_path):
    v = np.random.default_rng(4).normal(size=(3, *SIZE[::-1])).astype("f4").astype(float)
    rows = field_rows(spark, v)
    volume_files.write_fields(rows, str(tmp_path / "f"), SIZE, (1, 2, 3))
    (row,) = volume_files.read_fields(spark, str(tmp_path / "f")).collect()
    assert np.allclose(as_field(row, SIZE), v) and row["spacing"] == [1.0, 2.0, 3.0]
    volume_files.write_fields(rows, str(tmp_path / "c"), SIZE, split=True)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["0_x.mha", "0_y.mha", "0_z.mha"]
    volumes = images(spark, v[0])
    for axis, want in (("x", v[0][:, :, 1]), ("y", v[0][:, 1]), ("z", v[0][1])):
        (row,) = volume_files.slices_of(volumes, SIZE, axis, 1).collect()
        assert np.allclose(np.array(row["data"]).reshape(-1, row["columns"]), want)
    volume_files.write_slices(volumes, str(tmp_path / "s"), SIZE, "z", 1)
    picture = (tmp_path / "s/0_z1.pgm").read_bytes()
    assert picture.startswith(b"P5\n4 5\n255\n") and len(picture) == len(b"P5\n4 5\n255\n") + 20 and {0, 255} <= set(picture[-20:])
    volume_files.write_slices(volumes, str(tmp_path / "s"), SIZE, "z", 1, "raw")
    assert np.allclose(np.frombuffer((tmp_path / "s/0_z1.raw").read_bytes(), "<f4"), v[0][1].ravel())


def test_image_sets(spark):
    rows = catalogue.image_set(spark, [("a.mha", 1.0), ("b.mha", 3.0, range(9), (0, 0, 1)), ("c.mha",)])
    got = catalogue.part(rows, 1, 1).collect()
    assert [(r["path"], r["weight"]) for r in got] == [("b.mha", 0.6)] and got[0]["shift"] == [0.0, 0.0, 1.0]
    assert [r["path"] for r in catalogue.numbered(spark, "im%02d.mha", 3, 2).collect()] == ["im03.mha", "im04.mha"]


def test_meshes_are_cleaned_and_aligned(spark):
    points = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0), (9, 9, 9)]
    v, f = surface.mesh_tables(spark, 1, points, [(0, 1, 2), (3, 1, 2), (0, 3, 1)])
    kept, whole = surface.cleaned(v, f)
    assert {r["vid"] for r in kept.collect()} == {0, 1, 2} and [r["vids"] for r in whole.orderBy("fid").collect()] == [[0, 1, 2], [0, 1, 2]]
    moved = surface.aligned_centroids(v, v.withColumn("x", F.col("x") + 5)).agg(F.avg("x")).first()[0]
    assert moved == pytest.approx(7.0)
    back = surface.to_world(surface.to_index(v, (1, 2, 3), (2, 2, 2)), (1, 2, 3), (2, 2, 2))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))


@pytest.mark.parametrize("most", [0, 10_000])
def test_nearest_without_coordinates(spark, monkeypatch, most):
    monkeypatch.setattr(surface, "BROADCAST_POINTS", most)
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, 100.0, 0.0, 0.0)], "id long, x double, y double, z double")
    q = spark.createDataFrame([(0.0, 0.0, 2.0), (None, 0.0, 0.0)], "x double, y double, z double")
    got = {r["id"]: r["dist"] for r in surface.nearest_distance(p, q, ["id"]).collect()}
    assert got[1] == 2.0 and got[2] is None and got[3] is None and got[4] == pytest.approx(100.02, abs=1e-3)
    assert {r["dist"] for r in surface.nearest_distance(p, q.limit(0), ["id"]).collect()} == {None}


def test_geometry(spark):
    v = lambda *c: [F.lit(float(x)) for x in c]
    a, b, n = shapes.frame(v(0, 0, 5))
    checks = [shapes.dot(a, b), shapes.dot(a, n), shapes.dot(a, a), shapes.dot(b, b), n[2], shapes.midpoint(v(0, 0, 0), v(2, 4, 6))[1], shapes.on_plane(v(0, 0, -1), v(0, 0, 2), v(0, 0, 0), v(0, 0, 1))[0]]
    assert np.allclose(spark.range(1).select(*checks).first(), [0, 0, 1, 1, 1, 2, 0.5])
    assert spark.range(1).select(shapes.on_plane(v(0, 0, -1), v(1, 0, 0), v(0, 0, 0), v(0, 0, 1))[0]).first()[0] is None


def test_commands(spark, tmp_path, capsys):
    v = [ball(c, 3.0, 8) for c in (3.0, 3.5, 4.0)]
    volume_files.write_volumes(images(spark, *v), str(tmp_path / "in"), (8, 8, 8), (1, 1, 2))
    out = lambda name: {r["path"].rsplit("/", 1)[1]: r for r in volume_files.read_volumes(spark, str(tmp_path / name)).collect()}

    def run(command, name, *more):
        cli.main([command, str(tmp_path / "in"), str(tmp_path / name), *more], spark)
        return out(name)

    cli.main(["info", str(tmp_path / "in")], spark)
    assert "2.mha" in capsys.readouterr().out
    assert np.allclose(run("average", "average")["0.mha"]["data"], np.mean(v, 0).ravel(), atol=1e-6)
    assert np.allclose(run("threshold", "high", "--level", "0.5")["1.mha"]["data"], (v[1].ravel() > 0.5))
    assert np.allclose(run("roi", "box", "--start", "1", "2", "3", "--extent", "4", "3", "2")["0.mha"]["data"], v[0][3:5, 2:5, 1:5].ravel(), atol=1e-6)
    half = run("downsample", "half")["0.mha"]
    assert half["size"] == [4, 4, 4] and half["spacing"] == [2.0, 2.0, 4.0] and np.allclose(half["data"], v[0][::2, ::2, ::2].ravel(), atol=1e-6)
    assert run("isotropic", "iso")["0.mha"]["size"] == [8, 8, 15]
    assert len(run("prepare", "ready", "--taper", "2")) == 3
    moved = run("warp", "warped", "--iterations", "10", "--levels", "2:5,1")["2.mha"]["data"]
    assert np.abs(np.array(moved) - v[0].ravel()).sum() < np.abs(v[2] - v[0]).sum()
    run("atlas", "atlas", "--iterations", "2", "--method", "relaxation")
    assert set(out("atlas/mean")) == {"0.mha"} and len(out("atlas/deformed")) == 3
    volume_files.write_fields(field_rows(spark, np.full((3, 8, 8, 8), 0.25)), str(tmp_path / "u"), (8, 8, 8))
    cli.main(["field", str(tmp_path / "u"), str(tmp_path / "inverse"), "invert"], spark)
    (row,) = volume_files.read_fields(spark, str(tmp_path / "inverse")).collect()
    assert np.allclose(as_field(row, (8, 8, 8)), kernels.identity((8, 8, 8)) - 0.25)
    volume_files.write_volumes(images(spark, np.zeros(8)), str(tmp_path / "in/odd"), (2, 2, 2))
    with pytest.raises(ValueError, match="not congruent"):
        run("average", "again")
