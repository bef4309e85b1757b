"""Voxel means of images as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators.grid import AXES


def running_mean(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums and means by voxel of a stream (or table) of voxels; the state has one row a voxel and cohort."""
    return rows.groupBy(*keys, *AXES).agg(F.sum("v").alias("sum_v"), F.count("*").alias("n")).withColumn("mean_v", F.col("sum_v") / F.col("n"))


def windowed_stats(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Amplitude statistics of slices by time window; rows later than ``late`` are left out of finished windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean_v")).select("window.start", "window.end", "event_type", "n", "mean_v")
