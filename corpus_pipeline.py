"""A corpus pipeline of five stages over ``documents``.

Toxic documents go, of exact copies and of groups of near copies one document
stays, the sources are mixed to their target weights, and the mix, sorted
by range in its order, is packed into sequences. Every stage takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases: null texts count as empty; rows with a null or repeated doc_id are
decided by row; documents may have more columns, of any name; without documents
every stage returns no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from volspark.llm.common import by_size, cut, documents, shared_folder, unused, without_ids
from volspark.llm.registry import tokenizer


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key of the row as doc_id, and their own id in the column that own_id() names.

    The key is the doc_id where only one row has it. Rows with a null or repeated
    doc_id get a hash of all columns above 2 ** 62, so they come after the others
    and only rows that are the same in all columns share a key.
    """
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    repeated = cut(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    key, alone, again = (unused(docs, n) for n in ("_key", "_alone", "_again"))
    rows = docs.withColumn(key, own).withColumn(alone, F.col("doc_id").isNotNull())
    if not repeated.isEmpty():
        rows = rows.join(by_size(repeated.withColumn(again, F.lit(True))), "doc_id", "left").withColumn(alone, F.col(alone) & F.col(again).isNull()).drop(again)
    rows = rows.withColumn(key, F.when(F.col(alone), F.col("doc_id")).otherwise(F.col(key))).drop(alone)
    return rows.withColumnRenamed("doc_id", own_id(docs)).withColumnRenamed(key, "doc_id")


def own_id(docs: DataFrame) -> str:
    """The name under which keyed() keeps the documents' own ids."""
    return unused(docs, "_doc_id")


def unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with their own ids."""
    return rows.select(*[F.col(own_id(docs)).alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't predict to be toxic."""
    rows = keyed(docs)
    scored = toxicity.toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_id=own_id(docs))
    return unkeyed(without_ids(rows, cut(scored.filter("predicted = 1").select("doc_id").distinct())), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that stays; of rows that are the same in all columns, one."""
    rows = keyed(docs)
    decided = exact_dedup.exact_dedup(rows).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows"))
    decided = cut(decided.filter("NOT kept OR rows > 1"))
    kept = without_ids(rows, decided.filter("NOT kept").select("doc_id"))
    return unkeyed(kept.dropDuplicates(["doc_id"]) if not decided.filter("rows > 1").isEmpty() else kept, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each component of the n-gram join."""
    rows = keyed(docs)
    joined = ngram_join.ngram_join(rows)
    return unkeyed(without_ids(rows, cut(joined.filter("component_id <> doc_id").select("doc_id").distinct())), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, sorted by range of finish time; rows that are the same in all columns share what it takes."""
    rows = keyed(docs)
    times, count, first, lap, finish = (unused(rows, n) for n in ("_times", "_count", "_first", "_lap", "_finish"))
    taken = F.sum(F.when(F.col("taken") > 0, (F.col("taken") / F.col("size")).cast("long")).otherwise(0))
    sent = mixing.mix(rows).groupBy("doc_id").agg(taken.alias(times), F.count("*").alias(count), F.min("mix_finish").alias(first), F.max(F.col("source_size") / F.col("target")).alias(lap))
    sent = cut(sent.filter(F.col(times) > 0))
    if not sent.filter(F.col(count) > 1).isEmpty():
        rows = rows.dropDuplicates(["doc_id"])
    # A document that is taken again comes a round of its source later.
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col(times) - 1), lambda k: F.col(first) + k * F.col(lap))
    mixed = rows.join(by_size(sent), "doc_id").withColumn(finish, F.explode(each))
    return unkeyed(mixed.repartitionByRange(finish, "doc_id").sortWithinPartitions(finish, "doc_id"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, **tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A conditional random field and a packing by branch and bound are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; what a stage keeps is written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        if last:
            at = spark._jvm.org.apache.hadoop.fs.Path(last)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
