"""Connected components: union-find in one task for few links, alternating large and small stars beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import cut, drop


#: Links (16 bytes each) that one task may hold; the links are counted before.
FEW_LINKS = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = parent[p]
            i = p
        return i

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [i for i in parent if root(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(i) for i in nodes], pa.int64())], ["node", "label"])


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smaller of u and its smallest neighbour, for directed edges (u, v)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the smallest node reachable; nodes that are the smallest of theirs have no row.

    Every step is an aggregation to minima and a join back, which Spark can
    split for a node with very many links. Ends when the edges no longer change.
    FEW_LINKS links at most are joined up in one task instead, with the same result.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut(edges)
    if edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_union_find, "node long, label long")
    known = None
    while True:
        before, edges = edges, cut(_small_star(_large_star(edges)))
        drop(before)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())
        if now == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        known = now
