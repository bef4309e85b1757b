import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.config import GreedyParams, LDMMParams
from volspark.operators import fields, kernels, pca, registration, spectral, surface
from volspark.operators.grid import AXES
from volspark.sources import text_files, volume_files
from volspark.streaming.running_mean import running_mean

SIZE = (4, 5, 3)


def ball(centre, radius, n=12):
    x = kernels.identity((n, n, n))
    return 1 / (1 + np.exp(np.sqrt(((x - centre) ** 2).sum(0)) - radius))


def test_operator_and_inverse_cancel():
    f = np.random.default_rng(1).normal(size=(3, *SIZE[::-1]))
    for power in (1.0, 1.5):
        there = spectral.apply_operator(f, SIZE, power=power)
        assert np.allclose(spectral.apply_operator(there, SIZE, power=power, inverse=True), f)


def test_projection_is_free_of_divergence():
    f = np.random.default_rng(2).normal(size=(3, *SIZE[::-1]))
    v = spectral.apply_operator(f, SIZE, incompressible=True)
    div = sum(np.roll(v[i], -1, 2 - i) - np.roll(v[i], 1, 2 - i) for i in range(3))
    assert abs(div).max() < 1e-9


def test_sinc_upsample_keeps_samples():
    v = np.random.default_rng(3).normal(size=(5, 5, 5))
    assert np.allclose(spectral.sinc_upsample(v, 3)[::3, ::3, ::3], v)


@pytest.mark.parametrize(("method", "params"), [("greedy", GreedyParams(iterations=15)), ("shooting", LDMMParams(iterations=15)), ("relaxation", LDMMParams(iterations=15))])
def test_registration_lowers_energy(spark, method, params):
    a, b = ball(5.5, 3.0), ball(5.5, 4.0)
    pairs = spark.createDataFrame([(1, a.ravel().tolist(), b.ravel().tolist())], "pair_id long, moving array<double>, fixed array<double>")
    row = registration.register(pairs, (12, 12, 12), method, params).first()
    assert row["energy"][-1] < row["energy"][0]
    assert ((np.array(row["data"]) - b.ravel()) ** 2).sum() < ((a - b) ** 2).sum()


def test_affine_finds_shift():
    a, b = ball(5.0, 3.0), ball(6.0, 3.0)
    m, t, log = registration.affine_register(a, b)
    assert log[-1] < 0.2 * log[0] and t[0] < -0.5
    for mode in ("rigid", "translation"):
        m, t, log = registration.affine_register(a, b, mode)
        assert log[-1] < 0.2 * log[0] and np.allclose(m @ m.T, np.eye(3))
    assert np.allclose(registration.nearest_rotation(2 * np.eye(3)), np.eye(3))


@pytest.mark.parametrize("mode", ["affine", "rigid", "translation"])
def test_affine_of_a_stack_is_that_of_each_pair(spark, mode):
    """All pairs of a call at once, each with its own number of iterations; constant images and equal pairs are no trouble to others."""
    fixed = np.stack([ball(c, 3.0, 8) for c in (3.5, 3.0, 4.2)] + [np.ones((8, 8, 8)), ball(3.5, 2.0, 8)])
    moving = np.stack([ball(4.0, 3.0, 8), fixed[1], ball(3.5, 2.5, 8), np.zeros((8, 8, 8)), np.full((8, 8, 8), np.nan)])
    m, t, log, count = registration.affine_registers(moving, fixed, mode)
    for i in range(4):
        one = registration.affine_register(moving[i], fixed[i], mode)
        assert np.allclose(m[i], one[0], atol=1e-5) and np.allclose(t[i], one[1], atol=1e-5) and np.allclose(log[i, : count[i]], one[2], atol=1e-6)
    assert count[1] == count[4] == 1 < count[0]
    pairs = spark.createDataFrame([(i, moving[i].ravel().tolist(), fixed[i].ravel().tolist()) for i in range(4)], "pair_id long, moving array<double>, fixed array<double>").coalesce(1)
    found = registration.register(pairs, (8, 8, 8), mode, None).collect()
    assert [len(r.energy) for r in sorted(found, key=lambda r: r.pair_id)] == count[:4].tolist() and all(set(r.scale) == {1} for r in found)


def test_atlas_mean_sharpens(spark):
    rows = [(0, i, 1.0, ball(c, 3.0, 8).ravel().tolist()) for i, c in enumerate((3.0, 3.5, 4.0))]
    images = spark.createDataFrame(rows, "cohort int, image_id long, w double, data array<double>")
    energy = [registration.build_atlas(images, (8, 8, 8), GreedyParams(iterations=k))[1].agg(F.sum("energy")).first()[0] for k in (1, 5)]
    assert energy[1] < energy[0]


def test_power_components_match_svd(spark):
    x = np.random.default_rng(4).normal(size=(6, 8)) * np.linspace(1, 4, 8)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "image_id long, data array<double>")
    (value, _), = pca.power_components(v, (2, 2, 2), 1, 25)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert value == pytest.approx(s[0] ** 2 / 6, rel=1e-3)


def test_group_exponential_of_constant_shift(spark):
    u = spark.createDataFrame([(0, [0.5] * 64, [0.0] * 64, [0.0] * 64)], "image_id long, ux array<double>, uy array<double>, uz array<double>")
    x = kernels.identity((4, 4, 4))[0]
    h = np.array(fields.group_exponential(u, (4, 4, 4), 2).first()["hx"]).reshape(4, 4, 4)
    assert np.allclose(h[..., :2], x[..., :2] + 0.5)
    back = np.array(fields.invert(u, (4, 4, 4)).first()["hx"]).reshape(4, 4, 4)
    assert np.allclose(back[..., 2:], x[..., 2:] - 0.5)


def test_meshes(spark):
    points, facets = surface.sphere(2.0, 3)
    v, f = surface.mesh_tables(spark, 7, points, facets)
    t = surface.corners(f, v)
    row = surface.volume_and_centroid(t).first()
    assert row["volume"] == pytest.approx(4 / 3 * np.pi * 8, rel=0.03)
    assert abs(row["cx"]) < 1e-9
    assert surface.boundary_edges(f).filter("triangles <> 2 OR NOT oriented").isEmpty()
    n = surface.vertex_normals(t).join(v, ["surface_id", "vid"]).select((F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")).alias("d")).toPandas()
    assert (n["d"] > 1.9).all()
    cut = surface.plane_cut(t, (0, 0, 0.1), (0, 0, 1)).toPandas()
    assert np.allclose(cut["z0"], 0.1) and np.allclose(np.hypot(cut["x0"], cut["y0"]), np.sqrt(4 - 0.01), atol=0.05)


def test_nearest_by_cells_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(40, 3)) * 5)], "id long, x double, y double, z double")
    q = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(30, 3))], "x double, y double, z double")
    want = {r["id"]: r["dist"] for r in surface.nearest_distance(p, q, ["id"]).collect()}
    monkeypatch.setattr(surface, "BROADCAST_POINTS", 0)
    got = {r["id"]: r["dist"] for r in surface.nearest_distance(p, q, ["id"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_volume_files_round_trip(spark, tmp_path):
    data = np.random.default_rng(6).normal(size=60).astype("f4").astype(float)
    volumes = spark.createDataFrame([(3, data.tolist())], "image_id long, data array<double>")
    volume_files.write_volumes(volumes, str(tmp_path / "a"), SIZE, (1, 2, 3), (-1, 0, 5))
    (tmp_path / "a/b.nhdr").write_bytes(b"NRRD0004\ntype: float\ndimension: 3\nsizes: 4 5 3\nspace directions: (1,0,0) (0,2,0) (0,0,3)\nendian: little\nencoding: raw\nspace origin: (-1,0,5)\ndata file: b.raw\n")
    (tmp_path / "a/b.raw").write_bytes(data.astype("<f4").tobytes())
    rows = volume_files.read_volumes(spark, str(tmp_path / "a")).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r["size"], r["spacing"], r["origin"]) == (list(SIZE), [1.0, 2.0, 3.0], [-1.0, 0.0, 5.0]) and np.allclose(r["data"], data)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.vol").write_bytes(volume_files.encode_dump(data, SIZE))
    assert np.allclose(volume_files.read_dumps(spark, str(tmp_path / "d")).first()["data"], data)


def test_text_files_round_trip(spark, tmp_path):
    points, facets = surface.sphere()
    (tmp_path / "m.byu").write_text(text_files.format_byu(points, facets))
    (tmp_path / "m.off").write_text("OFF 3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2 255 0 0 0\n")
    v, f = text_files.read_meshes(spark, str(tmp_path / "m.*"))
    assert (v.count(), f.count()) == (9, 9)
    m, t = list(range(1, 10)), [0.5, 1.0, 2.0]
    assert text_files.parse_affine(text_files.format_affine(m, t)) == ([float(x) for x in m], t)
    (tmp_path / "index.csv").write_text("s1,a,b,1.5,0.2,0.7\n")
    assert tuple(text_files.read_slice_index(spark, str(tmp_path / "index.csv")).first()) == ("s1", 1.5, 0.2, 0.7)


def test_running_mean_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, 0, 0, float(i)) for i in range(10)], "image_id long, x int, y int, z int, v double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_mean(stream).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    got = {r["x"]: r["mean_v"] for r in spark.table("means").collect()}
    assert got == {0: 4.0, 1: 5.0} and list(AXES) == ["x", "y", "z"]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gram_blocks_do_not_grow_in_number(spark, monkeypatch):
    """An image goes to a bounded number of cells, however many images a cohort has."""
    from volspark.operators import pca

    for name, value in (("BLOCK", 4), ("BLOCKS", 3), ("PRODUCTS", 50)):
        monkeypatch.setattr(pca, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    rows = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "cohort int, image_id long, data array<double>")
    out = pca.gram_matrix(rows, ["cohort"])
    got = {(r.a, r.b): (r.cohort, r.dot) for r in out.collect()}
    assert len(got) == 2 * 45 * 46 // 2 == out.count()
    assert all(a <= b and a % 2 == b % 2 == c and np.isclose(d, x[a] @ x[b]) for (a, b), (c, d) in got.items())


def test_gram_products_leave_as_lists(spark):
    """A task hands a row an image and part of a block to Spark, not a row a pair."""
    import pyarrow as pa

    x = np.random.default_rng(4).normal(size=(6, 5))
    ids = np.array([5, 3, 9, 1, 3, 7])
    cell = lambda right: pa.RecordBatch.from_arrays([pa.array([0] * 6), pa.array([0] * 6), pa.array([right] * 6), pa.array(ids), pa.array(x.tolist()), pa.array([2] * 6)], names=["lo", "hi", "right", "image_id", "data", "cohort"])
    schema = pa.schema([("cohort", pa.int64()), ("a", pa.int64()), ("b", pa.list_(pa.int64())), ("dot", pa.list_(pa.float64()))])
    rows = [r for batch in pca._products([cell(0), cell(1)], schema) for r in batch.to_pylist()]
    assert len(rows) == 6 and [r["a"] for r in rows] == ids.tolist()
    for r, v in zip(rows, x, strict=True):
        keep = ids >= r["a"]
        assert r["b"] == ids[keep].tolist() and np.allclose(r["dot"], x[keep] @ v)


def test_rounded_without_decimals(spark):
    """The same doubles as F.round, also of ties, signs, large numbers, NaN and null; the plan rounds by decimals only beside that."""
    from volspark.plans.registered import finished

    odd = [None, 0.0, -0.0, -0.00001, 0.00005, -0.00005, 0.12345, 2.00005, 1.00015, 999999.99995, 1e6 + 0.00005, 1e15 + 0.3, 1e300, np.inf, -np.inf, np.nan]
    values = [*[k / 20000 for k in range(-500, 500)], *(np.random.default_rng(6).normal(size=500) * 10.0 ** np.arange(-5, 5).repeat(50)).tolist(), *odd]
    rows = finished(spark.createDataFrame([(v,) for v in values], "v double"), "v:d")
    want = spark.createDataFrame([(v,) for v in values], "v double").select((F.round("v", 4) + F.lit(0.0)).alias("v"))
    text = lambda df: [str(r.v) for r in df.select("v").collect()]
    assert text(rows) == text(want)
    assert "rint" in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_stack_counts_all_its_columns(spark):
    """Wide columns beside a narrow first one count as well, so a call's memory is bounded."""
    rows = spark.range(0, 600, 1, 1).select(F.col("id").alias("image_id"), F.array(F.lit(1.0)).alias("a"), F.array_repeat(F.lit(2.0), 4095).alias("b"))
    calls = kernels.map_images(rows, lambda s: {"n": np.full((len(s["a"]), 1), float(s["a"].size + s["b"].size))}, ["a", "b"], ["n"]).collect()
    assert len(calls) == 600 and max(r.n[0] for r in calls) <= kernels.STACK < 600 * 4096
