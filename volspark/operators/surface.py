"""Meshes (vertices, facets) and contours as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from volspark.plans.state import joined

XYZ = ("x", "y", "z")
#: Points that a broadcast reference set may have; beyond it nearest points are found by cells.
BROADCAST_POINTS = 10_000

#: The unit octahedron.
OCTAHEDRON = ((1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0))
OCTAHEDRON_FACETS = ((0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5))


def sphere(radius: float = 1.0, level: int = 0) -> tuple[list[tuple], list[tuple]]:
    """Vertices and triangles of an octahedron, every triangle cut in four ``level`` times, on the sphere."""
    points, facets = [tuple(p) for p in OCTAHEDRON], list(OCTAHEDRON_FACETS)
    for _ in range(level):
        known: dict[tuple, int] = {}

        def middle(a: int, b: int) -> int:
            key = (min(a, b), max(a, b))  # noqa: B023
            if key not in known:  # noqa: B023
                m = [(p + q) / 2 for p, q in zip(points[a], points[b], strict=True)]
                length = sum(c * c for c in m) ** 0.5
                known[key] = len(points)  # noqa: B023
                points.append(tuple(c / length for c in m))
            return known[key]  # noqa: B023

        new = []
        for a, b, c in facets:
            ab, bc, ca = middle(a, b), middle(b, c), middle(c, a)
            new += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        facets = new
    return [tuple(radius * c for c in p) for p in points], facets


def mesh_tables(spark: SparkSession, surface_id: int, points: Sequence, facets: Sequence) -> tuple[DataFrame, DataFrame]:
    v = spark.createDataFrame([(surface_id, i, *map(float, p)) for i, p in enumerate(points)], "surface_id long, vid int, x double, y double, z double")
    f = spark.createDataFrame([(surface_id, i, list(map(int, t))) for i, t in enumerate(facets)], "surface_id long, fid int, vids array<int>")
    return v, f


def triangulate(facets: DataFrame) -> DataFrame:
    """Facets of n corners as fans of n - 2 triangles, (surface_id, fid, part, a, b, c)."""
    part = F.explode(F.when(F.size("vids") >= 3, F.sequence(F.lit(1), F.size("vids") - 2))).alias("part")
    return facets.select("*", part).select("surface_id", "fid", "part", F.col("vids")[0].alias("a"), F.element_at("vids", F.col("part") + 1).alias("b"), F.element_at("vids", F.col("part") + 2).alias("c"))


def is_triangular(facets: DataFrame) -> DataFrame:
    return facets.groupBy("surface_id").agg(F.bool_and(F.size("vids") == 3).alias("triangular"))


def corners(facets: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners ax..cz."""
    rows = triangulate(facets)
    for k in "abc":
        v = vertices.select("surface_id", F.col("vid").alias(k), *[F.col(a).alias(k + a) for a in XYZ])
        rows = joined(rows, v, ["surface_id", k])
    return rows


def _cross(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def _edge(k: str, o: str) -> list[Column]:
    return [F.col(k + a) - F.col(o + a) for a in XYZ]


def volume_and_centroid(triangles: DataFrame) -> DataFrame:
    """Signed volume by tetrahedra to the origin, centroid, and area of each surface."""
    bc = _cross([F.col("b" + a) for a in XYZ], [F.col("c" + a) for a in XYZ])
    six = sum((F.col("a" + a) * m for a, m in zip(XYZ[1:], bc[1:], strict=True)), F.col("ax") * bc[0])
    n = _cross(_edge("b", "a"), _edge("c", "a"))
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    centre = [(F.sum(six * (F.col("a" + a) + F.col("b" + a) + F.col("c" + a)) / 4) / F.sum(six)).alias(f"c{a}") for a in XYZ]
    return triangles.groupBy("surface_id").agg((F.sum(six) / 6).alias("volume"), F.sum(area).alias("area"), *centre)


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """Unit sums of the normals of the triangles at each vertex."""
    n = _cross(_edge("b", "a"), _edge("c", "a"))
    rows = triangles.select("surface_id", F.explode(F.array("a", "b", "c")).alias("vid"), *[c.alias(f"n{a}") for c, a in zip(n, XYZ, strict=True)])
    sums = rows.groupBy("surface_id", "vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in XYZ])
    length = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return sums.withColumn("_l", length).select("surface_id", "vid", *[F.when(F.col("_l") > 0, F.col(f"n{a}") / F.col("_l")).otherwise(0.0).alias(f"n{a}") for a in XYZ])


def extent(points: DataFrame, *keys: str) -> DataFrame:
    """Bounding box and mean of the vertices."""
    return points.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for a in XYZ])


def plane_cut(triangles: DataFrame, point: Sequence[float], normal: Sequence[float]) -> DataFrame:
    """(surface_id, fid, part, x0..z1): the segment of each triangle on the plane; the side of a corner on it is positive."""
    side = {k: sum(((F.col(k + a) - float(p)) * float(n) for a, p, n in zip(XYZ, point, normal, strict=True)), F.lit(0.0)) for k in "abc"}
    rows = triangles.withColumns({f"_s{k}": s for k, s in side.items()})

    def hit(p: str, q: str) -> Column:
        t = F.col(f"_s{p}") / (F.col(f"_s{p}") - F.col(f"_s{q}"))
        at = F.struct(*[(F.col(p + a) + t * (F.col(q + a) - F.col(p + a))).alias(a) for a in XYZ])
        return F.when((F.col(f"_s{p}") >= 0) != (F.col(f"_s{q}") >= 0), at)

    ends = F.filter(F.array(hit("a", "b"), hit("b", "c"), hit("c", "a")), lambda e: e.isNotNull())
    rows = rows.withColumn("_e", ends).filter(F.size("_e") == 2)
    return rows.select("surface_id", "fid", "part", *[F.col("_e")[k][a].alias(f"{a}{k}") for k in (0, 1) for a in XYZ])


def boundary_edges(facets: DataFrame) -> DataFrame:
    """Edges with the number of triangles on them and whether both run in opposite directions."""
    t = triangulate(facets)
    e = F.explode(F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "bc", "ca")])).alias("e")
    rows = t.select("surface_id", e).select("surface_id", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi"), F.when(F.col("e.p") < F.col("e.q"), 1).otherwise(-1).alias("d"))
    return rows.groupBy("surface_id", "lo", "hi").agg(F.count("*").alias("triangles"), (F.sum("d") == 0).alias("oriented"))


def perimeter(points: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Sum of the lengths between consecutive points of a contour."""
    over = W.partitionBy(*keys).orderBy(order)
    squares = sum((F.pow(F.col(a) - F.lag(a).over(over), 2) for a in XYZ), F.lit(0.0))
    return points.withColumn("_d", F.sqrt(squares)).groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("perimeter"), F.count("*").alias("points"))


_FAR = 1 << 18


def _nearest(batches: Iterator[pa.RecordBatch], reference: np.ndarray, keys: int) -> Iterator[pa.RecordBatch]:
    """Distances of the points (last three columns) to the nearest of the reference, some at a time."""
    step = max(1, _FAR // max(1, len(reference)))
    for batch in batches:
        p = np.stack([batch.column(keys + i).to_numpy(zero_copy_only=False) for i in range(3)], 1).astype(np.float64)
        near = [((p[i : i + step, None] - reference[None]) ** 2).sum(2).min(1) for i in range(0, len(p), step)]
        dist = np.sqrt(np.concatenate([np.zeros(0), *near]))
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(keys)], pa.array(dist)], [*batch.schema.names[:keys], "dist"])


def nearest_distance(points: DataFrame, reference: DataFrame, keys: Sequence[str], cell: float = 1.0) -> DataFrame:
    """(keys, dist): distance of each point to the nearest point of the reference; null where a coordinate or the reference is missing.

    A reference of at most BROADCAST_POINTS points, which is counted before, goes
    to every task. A larger one is found by cells: the 27 cells around a point
    hold all points within the cell's width, so a distance up to it is final, and
    the rest is tried again with cells of twice the width, until none is left.
    """
    from volspark.plans.state import cut

    square = lambda p, q: sum(((p[a] - q[a]) * (p[a] - q[a]) for a in XYZ[1:]), (p["x"] - q["x"]) * (p["x"] - q["x"]))
    reference = reference.select(*[F.col(a).cast("double").alias(a) for a in XYZ]).dropna()
    points = points.select(*keys, *[F.col(a).cast("double").alias(a) for a in XYZ])
    lost = F.lit(False)
    for a in XYZ:
        lost = lost | F.col(a).isNull() | F.isnan(a)
    none = points.filter(lost).select(*keys, F.lit(None).cast("double").alias("dist"))
    points = points.filter(~lost)
    few = reference.limit(BROADCAST_POINTS + 1).toPandas()
    if len(few) == 0:
        return none.unionByName(points.select(*keys, F.lit(None).cast("double").alias("dist")))
    if len(few) <= BROADCAST_POINTS:
        schema = StructType([*[points.schema[k] for k in keys], StructField("dist", DoubleType())])
        spread = points.repartition(4 * points.sparkSession.sparkContext.defaultParallelism)
        return spread.mapInArrow(partial(_nearest, reference=few.to_numpy(np.float64), keys=len(keys)), schema).unionByName(none)
    left, done = cut(points), none
    while True:
        at = {a: F.floor(F.col(a) / F.lit(cell)) for a in XYZ}  # noqa: B023
        ref = reference.select(*[at[a].alias(f"_{a}") for a in XYZ], F.struct(*XYZ).alias("_q"))
        step = F.sequence(F.lit(-1), F.lit(1))
        near = left.select(*keys, *XYZ, F.explode(F.transform(step, lambda d: at["x"] + d)).alias("_x"), at["y"].alias("_by"), at["z"].alias("_bz"))
        near = near.withColumn("_y", F.explode(F.transform(step, lambda d: F.col("_by") + d))).withColumn("_z", F.explode(F.transform(step, lambda d: F.col("_bz") + d)))
        found = near.join(ref, ["_x", "_y", "_z"]).groupBy(*keys).agg(F.min(F.sqrt(square(F.struct(*XYZ), F.col("_q")))).alias("dist")).filter(F.col("dist") <= cell)
        found = cut(found)
        done = done.unionByName(found)
        left = cut(left.join(found.select(*keys), list(keys), "left_anti"))
        if left.isEmpty():
            return done
        cell *= 2


def cleaned(vertices: DataFrame, facets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of a surface without repeated places (the smallest vid stays) and those that no facet uses; facets without repeated corners."""
    same = vertices.groupBy("surface_id", *XYZ).agg(F.min("vid").alias("keep"))
    moved = vertices.join(same, ["surface_id", *XYZ]).select("surface_id", "vid", "keep")
    corner = facets.select("surface_id", "fid", F.posexplode("vids").alias("at", "vid")).join(moved, ["surface_id", "vid"])
    whole = corner.groupBy("surface_id", "fid").agg(F.array_sort(F.collect_list(F.struct("at", "keep")))["keep"].alias("vids"))
    whole = whole.withColumn("vids", F.array_distinct("vids")).filter(F.size("vids") >= 3)
    used = whole.select("surface_id", F.explode("vids").alias("vid")).distinct()
    return vertices.join(used, ["surface_id", "vid"], "left_semi"), whole


def to_index(points: DataFrame, origin: Sequence[float], spacing: Sequence[float]) -> DataFrame:
    """World coordinates to those of an image's voxels."""
    return points.withColumns({a: (F.col(a) - float(o)) / float(s) for a, o, s in zip(XYZ, origin, spacing, strict=True)})


def to_world(points: DataFrame, origin: Sequence[float], spacing: Sequence[float]) -> DataFrame:
    """Coordinates of an image's voxels to the world."""
    return points.withColumns({a: F.col(a) * float(s) + float(o) for a, o, s in zip(XYZ, origin, spacing, strict=True)})


def aligned_centroids(moving: DataFrame, fixed: DataFrame, key: str = "surface_id") -> DataFrame:
    """The points of each moving surface shifted so that their mean is that of the fixed points with the same key."""
    mean = lambda df, p: df.groupBy(key).agg(*[F.avg(a).alias(p + a) for a in XYZ])
    both = moving.join(mean(moving, "_m"), key).join(mean(fixed, "_f"), key)
    return both.withColumns({a: F.col(a) + F.col("_f" + a) - F.col("_m" + a) for a in XYZ}).drop(*[p + a for p in ("_m", "_f") for a in XYZ])


def hausdorff(points: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximum and mean of the nearest distances from the points to the reference."""
    return nearest_distance(points, reference, keys).agg(F.max("dist").alias("hausdorff"), F.avg("dist").alias("mean_dist"))
