"""Relational metadata of imaging files: catalogues, dictionaries, uids, slice binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(files: DataFrame, digest: Column, key: str) -> DataFrame:
    """(digest, first key, copies): each content once, as an import that looks digests up would keep it."""
    return files.groupBy(digest.alias("digest")).agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))


def known(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files whose digest is in the table."""
    return files.join(digests, "digest", "left_semi")


def unknown(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files whose digest is not in the table: what a second import adds."""
    return files.join(digests, "digest", "left_anti")


def dictionary(rows: DataFrame, standard: Column, order: Sequence[Column]) -> DataFrame:
    """Standard entries with their place in the order.

    Entries are dealt by ranges of the order; each range numbers its own, from
    the number of entries in the ranges before, a table of one row a range.
    """
    from volspark.plans.state import cut

    dealt = cut(rows.filter(standard).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + own).drop("_part", "_before")


def assign_uids(rows: DataFrame, root: str, group: str, order: str) -> DataFrame:
    """uid = root.group.sequence, sequences from 1 in each group."""
    seq = F.row_number().over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("uid", F.concat_ws(".", F.lit(root), F.col(group).cast("string"), seq.cast("string")))


def bin_slices(rows: DataFrame, bin_: Column, value: str, target: float, key: str, limit: float | None = None) -> DataFrame:
    """For each bin the slice whose value is closest to the target, then the smallest key; none beyond ``limit``."""
    away = F.abs(F.col(value) - F.lit(target))
    rows = rows.withColumn("_away", away).withColumn("bin", bin_)
    if limit is not None:
        rows = rows.filter(F.col("_away") <= limit)
    best = F.min(F.struct("_away", key, value))
    return rows.groupBy("bin").agg(best.alias("b"), F.count("*").alias("n")).select("bin", F.col(f"b.{key}").alias(key), F.col(f"b.{value}").alias(value), F.col("b._away").alias("away"), "n")


def blocks(total: Column, bins: int) -> Column:
    """Array of (bin, first, count): contiguous blocks whose sizes differ by one at most, larger ones first."""
    small, more = F.floor(total / bins), total % bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.alias("bin"), (b * small + F.least(b.cast("long"), more)).alias("first"), (small + F.when(b < more, 1).otherwise(0)).alias("n")))
