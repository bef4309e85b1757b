"""Running sums over a whole table, in two levels.

Rows are dealt by range of their order; each range sums its own, and one row a
range carries sums, extremes and open segments over from the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.plans.state import cut

PART = "scan_part"


def _ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    return cut(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _earlier():
    """The ranges before; one row a range, so as many rows as the shuffle has partitions."""
    return W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)


def _local(order: Sequence[str]):
    return W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def global_scan(rows: DataFrame, order: Sequence[str], value: str = "v") -> DataFrame:
    """Adds scan_sum, scan_before, scan_min and scan_max over all rows so far; ``order`` tells all rows apart. Null values count as none."""
    dealt = _ranged(rows, order)
    totals = dealt.groupBy(PART).agg(F.sum(value).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    carried = totals.select(PART, F.coalesce(F.sum("_s").over(_earlier()), F.lit(0.0)).alias("_s"), F.min("_lo").over(_earlier()).alias("_lo"), F.max("_hi").over(_earlier()).alias("_hi"))
    own = _local(order)
    out = dealt.withColumns({"_sum": F.coalesce(F.sum(value).over(own), F.lit(0.0)), "_min": F.min(value).over(own), "_max": F.max(value).over(own)}).join(F.broadcast(carried), PART)
    total = F.col("_s") + F.col("_sum")
    return out.select(*rows.columns, total.alias("scan_sum"), (total - F.coalesce(F.col(value), F.lit(0.0))).alias("scan_before"), F.least("_lo", "_min").alias("scan_min"), F.greatest("_hi", "_max").alias("scan_max"))


def global_segments(rows: DataFrame, order: Sequence[str], head: Column, value: str = "v") -> DataFrame:
    """Adds seg, which counts the rows with ``head`` so far, and seg_sum, the running sum since the last of them, over all rows."""
    dealt = _ranged(rows.withColumn("_head", F.when(head, 1).otherwise(0)), order)
    own = _local(order)
    local = dealt.withColumn("_seg", F.sum("_head").over(own))
    sums = local.withColumn("_sum", F.sum(value).over(W.partitionBy(PART, "_seg").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    # What is open at the end of a range: its last segment, which begins earlier if the range has no head.
    ends = local.groupBy(PART, "_seg").agg(F.sum(value).alias("_open")).groupBy(PART).agg(F.max("_seg").alias("_heads"), F.max_by("_open", "_seg").alias("_open"))
    since = F.max(F.when(F.col("_heads") > 0, F.col(PART))).over(_earlier())
    ends = ends.withColumns({"_before": F.coalesce(F.sum("_heads").over(_earlier()), F.lit(0)), "_last": since, "_upto": F.coalesce(F.sum("_open").over(_earlier()), F.lit(0.0))})
    start = ends.select(F.col(PART).alias("_last"), F.col("_upto").alias("_from"))
    carried = ends.join(start, "_last", "left").select(PART, "_before", (F.col("_upto") - F.coalesce("_from", F.lit(0.0))).alias("_carry"))
    out = sums.join(F.broadcast(carried), PART)
    return out.select(*rows.columns, (F.col("_before") + F.col("_seg")).alias("seg"), (F.coalesce("_sum", F.lit(0.0)) + F.when(F.col("_seg") == 0, F.col("_carry")).otherwise(0.0)).alias("seg_sum"))


def kth_bisection(rows: DataFrame, k: int, keys: Sequence[str], value: str = "v") -> DataFrame:
    """(*keys, kth_v): the k-th smallest value of each key, from 0, without a sort.

    A round counts the values up to the middle of each key's bounds, and moves a
    bound to the nearest value, so only partial counts move; keys whose bounds have
    met are done. Nulls are left out, and keys with k values or fewer.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    bounds = cut(rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")).filter(F.col("_n") > k).drop("_n"))
    found: list[DataFrame] = []
    while True:
        found.append(bounds.filter("_lo = _hi").select(*keys, F.col("_lo").alias("kth_v")))
        middle = F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2
        open_ones = bounds.filter("_lo < _hi").withColumn("_mid", F.when(middle >= F.col("_hi"), F.col("_lo")).otherwise(middle))
        if open_ones.isEmpty():
            break
        low = F.col("_v") <= F.col("_mid")
        counted = rows.join(open_ones, list(keys)).groupBy(*keys).agg(
            F.sum(F.when(low, 1).otherwise(0)).alias("_n"), F.max(F.when(low, F.col("_v"))).alias("_below"), F.min(F.when(~low, F.col("_v"))).alias("_above"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")
        )
        here = F.col("_n") > k
        bounds = cut(counted.select(*keys, F.when(here, F.col("_lo")).otherwise(F.col("_above")).alias("_lo"), F.when(here, F.col("_below")).otherwise(F.col("_hi")).alias("_hi")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
