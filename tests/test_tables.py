"""Scans, bisection, draws, steps and anonymisation on small awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.operators import anonymize, contours, draws, orientation, scans, surface


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, float(v), int(rng.random() < 0.02)) for i, v in enumerate(rng.normal(size=500))] + [(500, None, 0)], "i long, v double, head int").repartition(7)


def test_global_scan_and_segments(rows):
    own = rows.orderBy("i").toPandas()
    got = scans.global_scan(rows, ["i"]).orderBy("i").toPandas()
    v = own.v.fillna(0).to_numpy()
    assert np.allclose(got.scan_sum, v.cumsum()) and np.allclose(got.scan_before, v.cumsum() - v)
    assert np.allclose(got.scan_min[:500], np.minimum.accumulate(own.v[:500])) and np.allclose(got.scan_max[:500], np.maximum.accumulate(own.v[:500]))
    seg = scans.global_segments(rows, ["i"], F.col("head") == 1).orderBy("i").toPandas()
    number = own["head"].cumsum()
    assert (seg.seg == number).all() and np.allclose(seg.seg_sum, own.v.fillna(0).groupby(number).cumsum())
    assert scans.global_scan(rows.limit(0), ["i"]).count() == 0 and scans.global_segments(rows.limit(0), ["i"], F.col("head") == 1).count() == 0


def test_bisection_with_ties_and_short_keys(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.choice([0.5, 1.0, -3.0, 7.25, 1e9, 1 + 2**-52], size=n).tolist() for k, n in enumerate((1, 3, 4, 9, 60))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [(2, None)], "k int, v double")
    got = {r.k: r.kth_v for r in scans.kth_bisection(df, 2, ["k"]).collect()}
    assert got == {k: sorted(vs)[2] for k, vs in data.items() if len(vs) > 2}


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(20000)
    columns = [draws.uniform(F.col("id"), 0, 1).alias("u"), draws.integer(F.col("id"), 1, 3, 8, 1).alias("i"), draws.normal(F.col("id"), 0, 1).alias("n")]
    a = df.repartition(3).select("id", *columns).orderBy("id").toPandas()
    b = df.repartition(5, "id").select("id", *columns).orderBy("id").toPandas()
    assert a.equals(b)
    assert 0 < a.u.min() and a.u.max() < 1 and abs(a.u.mean() - 0.5) < 0.01 and abs(a.u.var() - 1 / 12) < 0.003
    assert set(a.i) == set(range(3, 9)) and abs(a.n.mean()) < 0.03 and abs(a.n.std() - 1) < 0.03 and abs(a.u.autocorr()) < 0.03
    assert a.u.nunique() > 19990


def test_values_between_steps(spark):
    steps = spark.createDataFrame([(1, 0.0, [0.0, 10.0]), (1, 2.0, [4.0, 20.0]), (1, 3.0, [5.0, 0.0])], "path_id long, t double, v array<double>")
    samples = spark.createDataFrame([(1, t, n) for n, t in enumerate((-1.0, 0.0, 0.5, 2.0, 2.75, 9.0))] + [(2, 0.0, 6)], "path_id long, t double, n int")
    got = {r.n: r.v for r in draws.between_steps(steps, samples, ["v"]).collect()}
    assert got == {0: [0.0, 10.0], 1: [0.0, 10.0], 2: [1.0, 12.5], 3: [4.0, 20.0], 4: [4.75, 5.0], 5: [5.0, 0.0], 6: None}


def test_anonymisation_keeps_joins_and_no_original(spark, tmp_path):
    people = spark.createDataFrame([(7, "Ann", "seen Ann, not Anna"), (8, "Bob", None), (None, "Ann", "x")], "id long, name string, note string")
    visits = spark.createDataFrame([("8", 1), ("9", 2), (None, 3), ("8", 4)], "who string, n int")
    kinds = [{"id": "p", "name": "n"}, {"who": "p"}]
    mapping = anonymize.pass_one([(people, kinds[0]), (visits, kinds[1])], "1.5")
    assert {(r.kind, r.original): r.replacement for r in mapping.collect()} == {("p", "7"): "1.5.p.1", ("p", "8"): "1.5.p.2", ("p", "9"): "1.5.p.3", ("n", "Ann"): "1.5.n.1", ("n", "Bob"): "1.5.n.2"}
    new = anonymize.pass_two(people, kinds[0], mapping, overrides={"note": anonymize.substituted("note", {"Ann": "$1"})}, marked="done")
    assert new.columns == ["id", "name", "note", "done"]
    assert {tuple(r) for r in new.collect()} == {("1.5.p.1", "1.5.n.1", "seen $1, not Anna", "YES"), ("1.5.p.2", "1.5.n.2", None, "YES"), (None, "1.5.n.1", "x", "YES")}
    seen = anonymize.pass_two(visits, kinds[1], mapping)
    assert new.join(seen, new.id == seen.who).count() == 2 == people.join(visits, people.id.cast("string") == visits.who).count()
    assert anonymize.pass_two(people, kinds[0], mapping, deleted=["note"]).columns == ["id", "name"]
    arrive = anonymize.Arrivals(f"{tmp_path}/map", f"{tmp_path}/out", kinds[1], "1.5")
    arrive(visits, 0)
    arrive(visits.unionByName(spark.createDataFrame([("1", 5)], visits.schema)), 1)
    arrive(visits.unionByName(spark.createDataFrame([("1", 5)], visits.schema)), 1)
    assert {r.original: r.number for r in arrive.mapping(spark).collect()} == {"8": 1, "9": 2, "1": 3}
    assert spark.read.parquet(f"{tmp_path}/out").filter("batch = 1 AND who = '1.5.p.3'").count() == 1


def test_contours_of_two_spheres_and_an_open_one(spark):
    """Loops of separate parts of one surface stay apart; a mesh with a hole on the plane has no closed loop."""
    points, facets = surface.sphere(level=2)
    two = [*points, *[(x + 5, y, z) for x, y, z in points]], [*facets, *[tuple(i + len(points) for i in f) for f in facets]]
    v, f = surface.mesh_tables(spark, 1, *two)
    open_v, open_f = surface.mesh_tables(spark, 2, points, [t for t in facets if not all(points[i][0] > 0 for i in t) or any(points[i][1] < 0 for i in t)])
    got = contours.contours(surface.corners(f.unionByName(open_f), v.unionByName(open_v)), (0, 0, 0.13), (0.05, 0.02, 1)).toPandas()
    assert set(got.surface_id) == {1} and got.groupby("loop").ngroups == 2
    for _, part in got.sort_values("place").groupby("loop"):
        assert part.place.tolist() == list(range(len(part)))
        p = part[["x", "y", "z"]].to_numpy()
        steps = np.linalg.norm(p - np.roll(p, -1, 0), axis=1)
        assert len(p) > 8 and steps.max() < 0.5 and np.allclose((p - (0, 0, 0.13)) @ (0.05, 0.02, 1), 0)
    assert contours.contours(surface.corners(f, v), (0, 0, 99), (0, 0, 1)).count() == 0


def test_orientation_of_shuffled_meshes(spark):
    """A long strip and two spheres with turned facets agree again; a strip with a twist isn't orientable."""
    rng = np.random.default_rng(4)
    _, facets = surface.sphere(level=2)
    two = [*facets, *[tuple(i + 1000 for i in f) for f in facets]]
    strip = [(2 * i, 2 * i + 1, 2 * i + 3, 2 * i + 2) for i in range(60)]
    ring = [(2 * i, 2 * i + 1, 2 * i + 3, 2 * i + 2) for i in range(7)] + [(14, 15, 0, 1)]
    rows = []
    for k, mesh in enumerate((two, strip, ring)):
        order = rng.permutation(len(mesh))
        turn = rng.random(len(mesh)) < 0.4
        rows += [(k, int(order[i]), list(map(int, f[::-1] if turn[i] else f))) for i, f in enumerate(mesh)]
    df = spark.createDataFrame(rows, "surface_id long, fid int, vids array<int>")
    got = orientation.orient(df).toPandas()
    assert len(got) == len(rows) and got.groupby("surface_id").component.nunique().tolist() == [2, 1, 1]
    assert got.groupby("surface_id").orientable.min().tolist() == [True, True, False]
    assert not got[got.fid == got.component].flip.any()
    mended = orientation.adjacency(orientation.oriented(df.filter("surface_id < 2")))
    assert mended.filter("s = 1").count() == 0 < orientation.adjacency(df).filter("s = 1").count()
    assert orientation.orient(df.limit(0)).count() == 0


def test_exploded_meshes_are_not_sent_to_all_tasks(spark):
    """Spark's size of exploded rows is too small, so its joins would collect whole meshes in the driver."""
    ids = spark.range(3).select(F.col("id").alias("surface_id"))
    points, facets = surface.sphere(level=1)
    each = lambda rows: F.posexplode(F.array(*[F.array(*map(F.lit, r)) for r in rows]))
    f = ids.select("surface_id", each(facets).alias("fid", "vids"))
    v = ids.select("surface_id", each(points).alias("vid", "p")).select("surface_id", "vid", *[F.col("p")[i].alias(a) for i, a in enumerate("xyz")])
    oriented, loops = orientation.orient(f), contours.contours(surface.corners(f, v), (0.1, 0.0, 0.3), (0.3, -0.2, 1.0))
    assert oriented.count() == 3 * len(facets)
    for df in (orientation.adjacency(f), oriented, surface.corners(f, v), loops):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_steps_after_a_time_need_no_frame_to_the_end(spark):
    """A frame that ends with the last row is read anew for each row, so a long path took the square of its length."""
    steps = spark.createDataFrame([(1, 0.0, [1.0]), (1, 2.0, [3.0])], "path_id long, t double, v array<double>")
    samples = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, 3.0)], "path_id long, t double")
    out = draws.between_steps(steps, samples, ["v"])
    assert sorted((r.t, r.v[0]) for r in out.collect()) == [(0.5, 1.5), (2.0, 3.0), (3.0, 3.0)]
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
