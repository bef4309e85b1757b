"""Volumes, fields and images derived from the plain tables, in Spark and in SQL.

Every embedding is a 4x4x4 volume, x fastest, with its label as cohort. Three
consecutive volumes make up a displacement field of at most 0.9 voxels. Line
items make up one 32x32 image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.operators.grid import unpacked, voxels

SIZE = (4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, cohort, data array<double>)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.col("label").alias("cohort"), F.col("embedding").cast("array<double>").alias("data"))


def vox(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(image_id, cohort, x, y, z, v); ``dealt`` by image_id for windows and sums of images."""
    return voxels(volumes(spark, sf_dir), SIZE, "data", "cohort", dealt=dealt)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with a weight of 1 + image_id mod 5, normalised over the cohort."""
    from volspark.operators.aggregate import normal_weights

    images = volumes(spark, sf_dir).withColumn("w", (F.col("image_id") % 5 + 1).cast("double"))
    return voxels(normal_weights(images, "w", ["cohort"]), SIZE, "data", "cohort", "w")


def dense_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, ux, uy, uz) as arrays; one join row an image."""
    v = volumes(spark, sf_dir).select("image_id", F.transform("data", lambda x: F.least(F.greatest(2 * x, F.lit(-0.9)), F.lit(0.9))).alias("u"))
    out = v.withColumnRenamed("u", "ux")
    for k, name in ((1, "uy"), (2, "uz")):
        out = out.join(v.select((F.col("image_id") - k).alias("image_id"), F.col("u").alias(name)), "image_id")
    return out


def fields(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(image_id, x, y, z, ux, uy, uz)."""
    return unpacked(dense_fields(spark, sf_dir), SIZE, ("ux", "uy", "uz"), dealt=dealt)


def placed(spark: SparkSession, sf_dir: str, sign: float = 1.0, spacing: tuple[float, float, float] = (1, 1, 1)) -> DataFrame:
    """(image_id, ux, uy, uz, px, py, pz, data): fields with their places and the volumes of the same image, one row an image."""
    from volspark.operators.fields import with_places

    return with_places(dense_fields(spark, sf_dir), SIZE, sign, spacing).join(volumes(spark, sf_dir).select("image_id", "data"), "image_id")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, z, v): quantities by part and supplier, partial sums in each task."""
    li = table(spark, sf_dir, "lineitem")
    keys = [F.lit(0).cast("long").alias("image_id"), (F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y"), F.lit(0).alias("z")]
    return li.groupBy(*keys).agg(F.sum("l_quantity").alias("v"))


#: Images of 32x32x32 voxels, and the side of their tiles.
LARGE, LARGE_SIDE = (32, 32, 32), 8


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, z, v, px, py, pz): quantities by order, part and supplier, one image a line number, 0 where there is none, and places up to 3.5 voxels away.

    Partial sums in each task; a voxel without a line item comes from the number of the voxel alone.
    """
    li = table(spark, sf_dir, "lineitem")
    at = [(F.col(c) % 32).cast("int").alias(a) for c, a in (("l_orderkey", "x"), ("l_partkey", "y"), ("l_suppkey", "z"))]
    sums = li.groupBy(F.col("l_linenumber").cast("long").alias("image_id"), *at).agg(F.sum("l_quantity").cast("double").alias("v"))
    i = F.col("i")
    every = sums.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(32**3 - 1))).alias("i"))
    every = every.select("image_id", (i % 32).alias("x"), (F.floor(i / 32) % 32).cast("int").alias("y"), F.floor(i / 1024).cast("int").alias("z"))
    rows = every.join(sums, ["image_id", "x", "y", "z"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    shift = lambda a, b, c: ((F.col("x") * a + F.col("y") * b + F.col("z") * c + F.col("image_id")) % 15 - 7) / 2.0
    return rows.withColumns({"px": F.col("x") + shift(7, 3, 5), "py": F.col("y") + shift(2, 11, 3), "pz": F.col("z") + shift(5, 4, 13)})


#: Common table expressions of the same relations.
CTES = {
    "big": """big AS MATERIALIZED (SELECT image_id, x, y, z, coalesce(v, 0) AS v, x + ((x * 7 + y * 3 + z * 5 + image_id) % 15 - 7) / 2.0::DOUBLE AS px, y + ((x * 2 + y * 11 + z * 3 + image_id) % 15 - 7) / 2.0::DOUBLE AS py, z + ((x * 5 + y * 4 + z * 13 + image_id) % 15 - 7) / 2.0::DOUBLE AS pz
      FROM (SELECT image_id, i % 32 AS x, (i // 32) % 32 AS y, i // 1024 AS z FROM (SELECT DISTINCT l_linenumber AS image_id FROM lineitem), (SELECT unnest(range(32768)) AS i))
      LEFT JOIN (SELECT l_linenumber AS image_id, l_orderkey % 32 AS x, l_partkey % 32 AS y, l_suppkey % 32 AS z, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) USING (image_id, x, y, z))""",
    "vox": """vox AS MATERIALIZED (SELECT vec_id AS image_id, label AS cohort, i % 4 AS x, (i // 4) % 4 AS y, i // 16 AS z, CAST(embedding[i + 1] AS DOUBLE) AS v
      FROM embeddings, (SELECT unnest(range(64)) AS i))""",
    "wvox": "wvox AS (SELECT v.*, (1 + image_id % 5) / CAST(t.total AS DOUBLE) AS w FROM vox v JOIN (SELECT label AS cohort, sum(1 + vec_id % 5) AS total FROM embeddings GROUP BY label) t USING (cohort))",
    "fld": """cl AS MATERIALIZED (SELECT image_id, x, y, z, least(greatest(2 * v, -0.9::DOUBLE), 0.9::DOUBLE) AS u FROM vox),
    fld AS MATERIALIZED (SELECT a.image_id, a.x, a.y, a.z, a.u AS ux, b.u AS uy, c.u AS uz FROM cl a
      JOIN cl b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z
      JOIN cl c ON c.image_id = a.image_id + 2 AND a.x = c.x AND a.y = c.y AND a.z = c.z)""",
    "flat": "flat AS (SELECT 0 AS image_id, l_partkey % 32 AS x, l_suppkey % 32 AS y, 0 AS z, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)",
    "corner": "corner AS (SELECT dx, dy, dz FROM (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz))",
}
NEEDS = {"wvox": ("vox",), "fld": ("vox",)}


def with_ctes(names: str, more: str = "") -> str:
    """WITH clause of the named relations and what they need, then ``more``."""
    found: list[str] = []
    for n in names.split():
        for m in (*NEEDS.get(n, ()), n):
            if m not in found:
                found.append(m)
    return "WITH RECURSIVE " + ",\n".join([*[CTES[n] for n in found], *([more] if more else [])])
