"""Statistics of an image, and voxel by voxel over a cohort of images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.grid import AXES


def image_stats(rows: DataFrame, *keys: str) -> DataFrame:
    v = F.col("v")
    return rows.groupBy(*(keys or ("image_id",))).agg(
        F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.sum(v).alias("sum_v"), F.avg(v).alias("mean_v"),
        F.sum(v * v).alias("sum_sq"), F.max(F.abs(v)).alias("max_abs"), F.sum(F.abs(v)).alias("sum_abs"), F.count("*").alias("n"),
    )


def centroid(rows: DataFrame, *keys: str) -> DataFrame:
    """Value-weighted mean index along each axis."""
    return rows.groupBy(*(keys or ("image_id",))).agg(*[(F.sum(F.col(a) * F.col("v")) / F.sum("v")).alias(f"c{a}") for a in AXES])


def l2_norm_sq(voxel_volume: float, v: Column) -> Column:
    return F.sum(v * v) * voxel_volume


def voxel_mean(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, sum, sample variance and count of the images at each voxel."""
    v = F.col("v")
    return rows.groupBy(*keys, *AXES).agg(F.avg(v).alias("mean_v"), F.sum(v).alias("sum_v"), F.var_samp(v).alias("var_v"), F.count("*").alias("n"))


def normal_weights(images: DataFrame, weight: str = "w", keys: Sequence[str] = ()) -> DataFrame:
    """Weights that add up to 1 over the whole set (or each cohort)."""
    total = images.groupBy(*keys).agg(F.sum(weight).alias("_total")) if keys else images.agg(F.sum(weight).alias("_total"))
    joined = images.join(total, list(keys)) if keys else images.join(F.broadcast(total))
    return joined.withColumn(weight, F.col(weight) / F.col("_total")).drop("_total")


def weighted_mean(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sum(w v); the caller has normalised the weights."""
    return rows.groupBy(*keys, *AXES).agg(F.sum(F.col("w") * F.col("v")).alias("mean_v"))


def weighted_stats(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, variance and deviation at each voxel by weights that add up to any sum: sum(w (v - m)^2) / sum(w)."""
    w, v = F.col("w"), F.col("v")
    total, mean = F.sum(w), F.sum(w * v) / F.sum(w)
    variance = F.greatest(F.sum(w * v * v) / total - mean * mean, F.lit(0.0))
    return rows.groupBy(*keys, *AXES).agg(mean.alias("mean_v"), variance.alias("var_v"), F.sqrt(variance).alias("std_v"))


def jacobian_mean(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """sum(w j v) / sum(w j): tasks send their partial sums, as threads and nodes would."""
    wj = F.col("w") * F.col("j")
    return rows.groupBy(*keys, *AXES).agg((F.sum(wj * F.col("v")) / F.sum(wj)).alias("mean_v"))


def incremental_mean(mean: Column, old: Column, new: Column, n: Column) -> Column:
    """The mean after one of n images has changed."""
    return (n * mean - old + new) / n


def distances(rows: DataFrame, mean: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Squared distance of each image to the mean (mean_v) of its cohort."""
    joined = rows.join(mean.select(*keys, *AXES, "mean_v"), [*keys, *AXES])
    return joined.groupBy(*keys, "image_id").agg(F.sum(F.pow(F.col("v") - F.col("mean_v"), 2)).alias("dist"))


def inverse_distance_mean(rows: DataFrame, dist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One step towards the geometric median: weights 1/distance, normalised."""
    w = (1 / F.sqrt("dist")).alias("w")
    joined = rows.join(dist.select(*keys, "image_id", w), [*keys, "image_id"])
    return joined.groupBy(*keys, *AXES).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean_v"))
