"""Random columns by a counter, and values of a path between its steps.

A draw is a function of (seed, key of the row, number of the draw) in integer
arithmetic, so it is the same for any partitioning and any retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A prime modulus and two multipliers with long periods.
MODULUS, FIRST, SECOND = 2147483647, 48271, 69621
ROUNDS = 4


def counter(key: Column, draw: int, seed: int = 0) -> Column:
    """A whole number from 0 to MODULUS - 1."""
    h = F.pmod(key.cast("long"), F.lit(MODULUS)) + (draw * SECOND + seed * FIRST + 1) % MODULUS
    for _ in range(ROUNDS):
        h = F.pmod(h * FIRST + SECOND, F.lit(MODULUS))
        h = h.bitwiseXOR(F.shiftright(h, 13))
        h = F.pmod(h * SECOND + FIRST, F.lit(MODULUS))
    return h


def uniform(key: Column, draw: int, seed: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    """Doubles over (low, high)."""
    return low + (high - low) * (counter(key, draw, seed) + 0.5) / float(MODULUS)


def integer(key: Column, draw: int, least: int, most: int, seed: int = 0) -> Column:
    """Whole numbers from least to most."""
    return least + F.floor(uniform(key, draw, seed) * (most - least + 1)).cast("long")


def normal(key: Column, draw: int, seed: int = 0, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """Normal numbers, each from two draws."""
    u, v = uniform(key, 2 * draw, seed + 1), uniform(key, 2 * draw + 1, seed + 1)
    return mean + deviation * F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def between_steps(steps: DataFrame, samples: DataFrame, values: Sequence[str], keys: Sequence[str] = ("path_id",), time: str = "t") -> DataFrame:
    """The columns of samples (*keys, t, ...) with the arrays of steps (*keys, t, *values) at their times, linear between the two steps around them.

    Times before the first or after the last step get that step. Steps and samples
    of a path are sorted together once, by times only; a path's arrays go to the
    samples that need them by two joins. Samples of a path without steps get nulls.
    """
    keys = list(keys)
    names = [*keys, time]
    marks = steps.select(*names, F.col(time).alias("_t"), F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in samples.dtypes) + ">").alias("_row"))
    asked = samples.select(*names, F.lit(None).cast(steps.schema[time].dataType).alias("_t"), F.struct(*samples.columns).alias("_row"))
    both = marks.unionByName(asked)
    over = W.partitionBy(*keys).orderBy(time, F.col("_t").isNull())
    before = F.last("_t", True).over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    # From the other end, as a frame that ends with the last row is read anew for each row.
    back = W.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("_t").isNull().desc())
    after = F.last("_t", True).over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
    near = both.withColumns({"_a": before, "_b": after}).filter("_row IS NOT NULL").select("_row", *keys, F.coalesce("_a", "_b").alias("_a"), F.coalesce("_b", "_a").alias("_b"))
    for side in ("a", "b"):
        arrays = steps.select(*keys, F.col(time).alias(f"_{side}"), *[F.col(v).alias(f"_{side}_{v}") for v in values])
        near = near.join(arrays, [*keys, f"_{side}"], "left")
    part = F.when(F.col("_b") > F.col("_a"), (F.col(f"_row.{time}") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
    near = near.withColumn("_part", part)
    mixed = [F.zip_with(f"_a_{v}", f"_b_{v}", lambda x, y: x * (1 - F.col("_part")) + y * F.col("_part")).alias(v) for v in values]
    return near.select(*[F.col(f"_row.`{c}`").alias(c) for c in samples.columns], *mixed)
