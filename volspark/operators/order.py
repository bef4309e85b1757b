"""Order statistics over a cohort at each voxel, and over images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.operators.grid import AXES


def ranked(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank r from 0 and count n of each value at its voxel; ties stand in the order of image_id."""
    over = W.partitionBy(*keys, *AXES)
    return rows.withColumn("r", F.row_number().over(over.orderBy("v", "image_id")) - 1).withColumn("n", F.count("*").over(over))


def trim_width(n: Column) -> Column:
    """Values left out at each end: none below 5 images, 1 below 10, then a fifth."""
    return F.when(n < 5, 0).when(n < 10, 1).otherwise(F.floor(n / 5))


def trimmed_mean(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    k = trim_width(F.col("n"))
    kept = ranked(rows, keys).filter((F.col("r") >= k) & (F.col("r") < F.col("n") - k))
    return kept.groupBy(*keys, *AXES).agg(F.avg("v").alias("mean_v"))


def winsorized_mean(rows: DataFrame, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """The values beyond ``width`` at each end count as the nearest one that is kept."""
    r, n = F.col("r"), F.col("n")
    times = F.when((r < width) | (r >= n - width), 0).when((r == width) & (r == n - width - 1), n).when((r == width) | (r == n - width - 1), width + 1).otherwise(1)
    return ranked(rows, keys).groupBy(*keys, *AXES).agg((F.sum(F.col("v") * times) / F.sum(times)).alias("mean_v"))


def kth(rows: DataFrame, k: Column | int, keys: Sequence[str] = ()) -> DataFrame:
    """The k-th smallest value, from 0, at each voxel."""
    return ranked(rows, keys).filter(F.col("r") == k).select(*keys, *AXES, F.col("v").alias("kth_v"))


def lower_median(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.col("n")
    return kth(rows, F.when(n % 2 == 0, F.floor(n / 2) - 1).otherwise(F.floor(n / 2)), keys).withColumnRenamed("kth_v", "median_v")


def closest_weights(dist: DataFrame, keep: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Equal weights for the ``keep`` images closest to the mean, 0 for the others; ties in the order of image_id.

    A plain rank takes exactly ``keep`` images, whatever ties there are.
    """
    over = W.partitionBy(*keys)
    rows = dist.withColumn("r", F.row_number().over(over.orderBy("dist", "image_id"))).withColumn("n", F.count("*").over(over))
    return rows.withColumn("w", F.when(F.col("r") <= keep, 1.0 / keep).otherwise(0.0)).select(*keys, "image_id", "w")


def in_order(images: DataFrame, data: str = "data") -> DataFrame:
    """(image_id, ordered, first_fault): whether the values of each image ascend, and the place of the first that doesn't, or -1."""
    fault = F.transform(F.sequence(F.lit(1), F.greatest(F.size(data) - 1, F.lit(1))), lambda i: F.when(F.get(data, i) < F.get(data, i - 1), i))
    return images.select("image_id", F.array_min(fault).alias("first_fault")).select("image_id", F.col("first_fault").isNull().alias("ordered"), F.coalesce("first_fault", F.lit(-1)).alias("first_fault"))
