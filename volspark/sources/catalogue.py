"""A weighted set of images as a catalogue of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ordinal int, path string, weight double, matrix array<double>, shift array<double>"


def image_set(spark: SparkSession, entries: Sequence[tuple], default_weight: float = 1.0) -> DataFrame:
    """(ordinal, path, weight, matrix, shift) of entries (path[, weight[, matrix, shift]]) in their order; the affine map may be missing."""
    rows = []
    for k, entry in enumerate(entries):
        path, weight, matrix, shift = (*entry, *[None] * (4 - len(entry)))
        rows.append((k, path, float(default_weight if weight is None else weight), None if matrix is None else [float(x) for x in matrix], None if shift is None else [float(x) for x in shift]))
    return spark.createDataFrame(rows, SCHEMA)


def numbered(spark: SparkSession, pattern: str, first: int, count: int, weight: float = 1.0) -> DataFrame:
    """The set of the files that a printf pattern names for ``count`` numbers."""
    i = F.col("id")
    return spark.range(count).select(i.cast("int").alias("ordinal"), F.format_string(pattern, (i + first).cast("int")).alias("path"), F.lit(float(weight)).alias("weight"), F.lit(None).cast("array<double>").alias("matrix"), F.lit(None).cast("array<double>").alias("shift"))


def part(images: DataFrame, base: int = 0, count: int | None = None, scale: bool = True, weight: str = "weight", ordinal: str = "ordinal") -> DataFrame:
    """The images from ``base`` on; weights are normalised over the whole set before."""
    if scale:
        total = images.agg(F.sum(weight).alias("_total"))
        images = images.join(F.broadcast(total)).withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")
    kept = F.col(ordinal) >= base
    return images.filter(kept if count is None else kept & (F.col(ordinal) < base + count))


def file_id(path: Column) -> Column:
    """A number of a file for operators that go by image_id."""
    return F.xxhash64(path)
