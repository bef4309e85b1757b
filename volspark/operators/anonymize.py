"""Consistent anonymisation of tables in two passes.

Pass one collects the identifiers of all tables, by kind, and gives each a number;
pass two replaces them by the mapping, so joins between tables still hold. A
mapping can be kept and extended: what arrives later reuses it, and only new
identifiers get new numbers. Numbers are given within ranges of the identifiers,
with one row a range to tell how many come before, so no task numbers them all.

Defined cases: null identifiers stay null and get no number; identifiers are
compared as text; equal identifiers of two kinds have replacements of their own;
a table without rows adds nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.plans.state import cut

#: Columns of a mapping.
MAPPING = ["kind", "original", "number", "replacement"]


def identifiers(tables: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Distinct (kind, original) of tables, each with the kinds of its identifying columns."""
    found = None
    for df, kinds in tables:
        pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("original")) for c, kind in kinds.items()])
        rows = df.select(F.explode(pairs).alias("p")).select("p.*").filter("original IS NOT NULL")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def pass_one(tables: Sequence[tuple[DataFrame, Mapping[str, str]]], root: str, known: DataFrame | None = None) -> DataFrame:
    """(kind, original, number, replacement): the mapping of all identifiers, ``root.kind.number``, that of ``known`` first.

    Numbers of a kind follow the order of the originals, after the largest known one.
    """
    new = identifiers(tables)
    if known is not None:
        new = new.join(known, ["kind", "original"], "left_anti")
        last = known.groupBy("kind").agg(F.max("number").alias("_last"))
    dealt = cut(new.repartitionByRange("kind", "original").withColumn("_part", F.spark_partition_id()))
    # One row for each range and kind, so the windows hold as many rows as the shuffle has partitions.
    sizes = dealt.groupBy("kind", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("kind").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("kind", "_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("kind", "_part").orderBy("original"))
    rows = dealt.join(starts, ["kind", "_part"]).withColumn("number", F.col("_before") + own)
    if known is not None:
        rows = rows.join(F.broadcast(last), "kind", "left").withColumn("number", F.col("number") + F.coalesce("_last", F.lit(0)))
    rows = rows.withColumn("replacement", F.concat_ws(".", F.lit(root), "kind", F.col("number").cast("string"))).select(*MAPPING)
    return rows if known is None else known.select(*MAPPING).unionByName(rows)


def pass_two(df: DataFrame, kinds: Mapping[str, str], mapping: DataFrame, deleted: Sequence[str] = (), overrides: Mapping[str, Column] | None = None, marked: str | None = None) -> DataFrame:
    """The table with its identifiers replaced, ``deleted`` columns left out, ``overrides`` set, and a column ``marked`` that says so.

    Column order stays. An identifier that isn't in the mapping becomes null, so no original is left.
    """
    out = df
    for k, (c, kind) in enumerate(kinds.items()):
        of = mapping.filter(F.col("kind") == kind).select(F.col("original").alias(f"_original{k}"), F.col("replacement").alias(f"_new{k}"))
        out = out.join(of, out[c].cast("string") == F.col(f"_original{k}"), "left").drop(f"_original{k}")
    place = {c: F.col(f"_new{k}").alias(c) for k, c in enumerate(kinds)} | {c: v.alias(c) for c, v in (overrides or {}).items()}
    columns = [place.get(c, F.col(f"`{c}`")) for c in df.columns if c not in deleted]
    return out.select(*columns, *([F.lit("YES").alias(marked)] if marked else []))


def substituted(column: str, words: Mapping[str, str]) -> Column:
    """Text with whole words replaced, as the parameters say; letters and digits are parts of words."""
    out = F.col(column)
    for word, new in words.items():
        out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])\Q" + word.replace("\\E", "") + r"\E(?![\p{L}\p{N}])", new.replace("\\", "\\\\").replace("$", "\\$"))
    return out


class Arrivals:
    """Batches of a stream that share one mapping, kept in a folder; for foreachBatch.

    Each batch adds its new identifiers in a folder of its own, named by the
    number of the batch, so a batch that is run again finds its own and adds
    nothing.
    """

    def __init__(self, folder: str, output: str, kinds: Mapping[str, str], root: str) -> None:
        self.folder, self.output, self.kinds, self.root = folder.rstrip("/"), output, dict(kinds), root

    def mapping(self, spark) -> DataFrame:
        """All identifiers so far."""
        schema = "kind string, original string, number long, replacement string"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.folder)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = self.mapping(spark)
        after = pass_one([(batch, self.kinds)], self.root, known)
        new = after.join(known.select("kind", "original"), ["kind", "original"], "left_anti")
        cut(new).write.mode("append").parquet(f"{self.folder}/batch={number}")
        pass_two(batch, self.kinds, self.mapping(spark)).write.mode("overwrite").parquet(f"{self.output}/batch={number}")
