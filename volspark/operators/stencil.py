"""Stencils, filters and scans as windows along the lines of an image."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.operators.grid import AXES, Size, interior, line


def _neighbours(value: str, axis: str, n: int, wrap: bool) -> tuple[Column, Column]:
    before, after = F.lag(value).over(line(axis)), F.lead(value).over(line(axis))
    if wrap:
        whole = line(axis).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        before = F.coalesce(before, F.last(value).over(whole))
        after = F.coalesce(after, F.first(value).over(whole))
    return before, after


def derivative(value: str, axis: str, n: int, spacing: float = 1.0, wrap: bool = False) -> Column:
    """Central difference; one-sided at the border, or periodic with ``wrap``."""
    before, after = _neighbours(value, axis, n, wrap)
    v = F.col(value)
    inner = (after - before) / (2 * spacing)
    if wrap:
        return inner
    if n < 2:
        return F.lit(0.0)
    return F.when(before.isNull(), (after - v) / spacing).when(after.isNull(), (v - before) / spacing).otherwise(inner)


def gradient(rows: DataFrame, size: Size, spacing: Sequence[float] = (1, 1, 1), wrap: bool = False, value: str = "v") -> DataFrame:
    return rows.select("*", *[derivative(value, a, n, s, wrap).alias(f"g{a}") for a, n, s in zip(AXES, size, spacing, strict=True)])


def laplacian(rows: DataFrame, size: Size, value: str = "v") -> DataFrame:
    """Sum of the six neighbours less six times the value; 0 at the border; spacing is ignored."""
    total = sum((F.lag(value).over(line(a)) + F.lead(value).over(line(a)) for a in AXES), F.lit(0.0))
    return rows.withColumn("lap", F.when(interior(size), total - 6 * F.col(value)).otherwise(0.0))


def field_laplacian(rows: DataFrame, size: Size, components: Sequence[str]) -> DataFrame:
    """The Laplacian of each component, as l + its name."""
    out = {}
    for c in components:
        total = sum((F.lag(c).over(line(a)) + F.lead(c).over(line(a)) for a in AXES), F.lit(0.0))
        out[f"l{c}"] = F.when(interior(size), total - 6 * F.col(c)).otherwise(0.0)
    return rows.select("*", *[v.alias(k) for k, v in out.items()])


def _each_axis(rows: DataFrame, step) -> DataFrame:
    for a in AXES:
        rows = rows.withColumn("v", step(a))
    return rows


def min_filter(rows: DataFrame) -> DataFrame:
    return _each_axis(rows, lambda a: F.min("v").over(line(a).rowsBetween(-1, 1)))


def max_filter(rows: DataFrame) -> DataFrame:
    return _each_axis(rows, lambda a: F.max("v").over(line(a).rowsBetween(-1, 1)))


def diffuse(rows: DataFrame, size: Size) -> DataFrame:
    """Mean of three along each axis in turn; the ends of a line stay."""
    n = dict(zip(AXES, size, strict=True))
    return _each_axis(rows, lambda a: F.when((F.col(a) > 0) & (F.col(a) < n[a] - 1), F.avg("v").over(line(a).rowsBetween(-1, 1))).otherwise(F.col("v")))


def gaussian_taps(sigma: float, half: int) -> list[float]:
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(rows: DataFrame, size: Size, sigma: Sequence[float], half: Sequence[int]) -> DataFrame:
    """Separable Gaussian; near an end the taps inside the line are normalised; half widths stop at size / 2 - 1."""
    for a, n, s, k in zip(AXES, size, sigma, half, strict=True):
        k = min(k, n // 2 - 1)
        if s <= 0 or k < 1:
            continue
        taps = gaussian_taps(s, k)
        near = {i: (F.lag("v", -i) if i < 0 else F.lead("v", i)).over(line(a)) if i else F.col("v") for i in range(-k, k + 1)}
        total = sum((F.coalesce(c * w, F.lit(0.0)) for (_, c), w in zip(near.items(), taps, strict=True)), F.lit(0.0))
        mass = sum((F.when(c.isNotNull(), w).otherwise(0.0) for (_, c), w in zip(near.items(), taps, strict=True)), F.lit(0.0))
        rows = rows.withColumn("v", total / mass)
    return rows


def divergence(rows: DataFrame, size: Size, components: Sequence[str], spacing: Sequence[float] = (1, 1, 1), wrap: bool = False) -> DataFrame:
    parts = [derivative(c, a, n, s, wrap) for c, a, n, s in zip(components, AXES, size, spacing, strict=True)]
    return rows.withColumn("div", parts[0] + parts[1] + parts[2])


def determinant(m: Sequence[Column]) -> Column:
    """Of a row-major 3x3 matrix."""
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def jacobian_det(rows: DataFrame, size: Size, components: Sequence[str], spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """Determinant of the derivative of a field."""
    names = [f"_j{c}{a}" for c in components for a in AXES]
    parts = [derivative(c, a, n, s).alias(f"_j{c}{a}") for c in components for a, n, s in zip(AXES, size, spacing, strict=True)]
    return rows.select("*", *parts).withColumn("jac", determinant([F.col(n) for n in names])).drop(*names)


def hessian(rows: DataFrame, size: Size, value: str = "v") -> DataFrame:
    """Second derivatives along each axis and across axes, by differences of differences."""
    first = gradient(rows, size, value=value)
    out = [derivative(f"g{a}", b, n).alias(f"h{a}{b}") for a in AXES for b, n in zip(AXES, size, strict=True) if a <= b]
    return first.select("*", *out)


def prefix_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "v", backward: bool = False) -> DataFrame:
    """Inclusive and exclusive running sum, running minimum and maximum, from the first or from the last."""
    over = W.partitionBy(*keys).orderBy(*[F.desc(o) if backward else F.asc(o) for o in order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(value).over(over)
    return rows.select("*", total.alias("scan_sum"), (total - F.col(value)).alias("scan_before"), F.min(value).over(over).alias("scan_min"), F.max(value).over(over).alias("scan_max"))


def segmented_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], head: Column, value: str = "v") -> DataFrame:
    """Running sums that start anew at each row with ``head``; seg numbers the segments from 0."""
    over = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("seg", F.sum(F.when(head, 1).otherwise(0)).over(over.rowsBetween(W.unboundedPreceding, W.currentRow)))
    inner = W.partitionBy(*keys, "seg")
    return rows.withColumn("seg_sum", F.sum(value).over(inner.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("seg_count", F.count("*").over(inner))
