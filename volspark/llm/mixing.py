"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and, where its
target is above its size, queued again. A queued document's virtual finish
time is the tokens its source has sent up to and with it, divided by the
source's target. All queues are merged by finish time and the merged list is
cut at the total budget, so every source has sent about its target.

Running sums are taken inside buckets of the hash and carried over by prefix
sums of bucket totals, so no task holds a whole source. The place of the cut is
found by histograms of finish times, refined until a bucket is small; the
driver sees at most FAN counts at a time.

Defined cases: null text has size 0; null source is a source of its own, the
last one; documents of size 0 are never taken; an empty table, or one without
words, gives targets and taken words of 0. Rows that repeat a doc_id are
queued one by one, in an order that doesn't matter for the totals; columns other
than doc_id, text and source are not read, and a text may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.llm.common import bucket_bits, cut, prefix_sums, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
FAN = 1024
#: Rows of the bucket with the cut that are ordered in one task.
FINE = 10_000


def place() -> Column:
    """A hash that shuffles the rows, of doc_id, or of the text where that is null."""
    text = F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    return F.md5(F.encode(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))), "UTF-8"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of each text, and the place of the row."""
    n = F.size(F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n.cast("long").alias("size"), place().alias("h"))


def targets(sized: DataFrame) -> DataFrame:
    """(skey, source_size, target), one row for each source; its windows hold one row a source.

    Sharing the excess by weight until no target is above its limit gives
    min(limit, level * weight) with one level for all; the level is found by
    going through the sources in the order of limit / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = (F.col("source_size") * MOST_TIMES).cast("double")
    per = per.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything, ordered = W.partitionBy(F.lit(1)), W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * SHARE_PERCENT / 100
    spent, used = F.coalesce(F.sum("limit").over(ordered), F.lit(0.0)), F.coalesce(F.sum("weight").over(ordered), F.lit(0.0))
    level = (budget - spent) / (F.sum("weight").over(everything) - used)
    per = per.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(everything)["level"]
    return per.select(_skey(), "source_size", F.when(final.isNull(), F.col("limit")).otherwise(F.least("limit", final * F.col("weight"))).alias("target"))


def _skey():
    """The source with null as a value that no source has."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("skey")


def queue(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, h, skey, epoch, finish): every document MOST_TIMES times."""
    sized = cut(sizes(docs))
    n = sized.count()
    sources = targets(sized)
    bits = bucket_bits(n)
    bucket = F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), max(0, 32 - min(bits, 32)))
    rows = sized.select("doc_id", "size", _skey(), "h").withColumn("bucket", bucket if bits else F.lit(0).cast("long"))
    before = prefix_sums(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words")), ["skey"], "bucket", "words", "before")
    inside = F.sum("size").over(W.partitionBy("skey", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.join(before, ["skey", "bucket"]).withColumn("sent", F.col("before") + inside)
    rows = rows.join(sources, "skey").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))))
    finish = F.when(F.col("target") > 0, (F.col("epoch") * F.col("source_size") + F.col("sent")).cast("double") / F.col("target"))
    return rows.select("doc_id", "size", "source_size", "target", "h", "skey", "epoch", finish.alias("finish"))


ORDER = ("finish", "skey", "epoch", "h", "doc_id")


def last_taken(queued: DataFrame, budget: float) -> tuple | None:
    """The place in ORDER of the last row that the budget allows; None if it allows all, () if none."""
    live = queued.filter("size > 0 AND finish IS NOT NULL")
    top = live.agg(F.max("finish").alias("m"), F.sum("size").alias("s")).first()
    if top["m"] is None or top["s"] <= budget:
        return None
    lo, hi, spent = 0.0, top["m"], 0
    # Each round narrows the range, until few rows are left or all have one finish time, which a source has once in an epoch.
    while True:
        at = F.least(F.floor((F.col("finish") - F.lit(lo)) / F.lit((hi - lo) / FAN)), F.lit(FAN - 1))
        inside = live.filter(F.col("finish").between(lo, hi))
        counts = sorted(inside.groupBy(at.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).collect())
        for r in counts:
            if spent + r["s"] > budget:
                break
            spent += r["s"]
        lo, hi = r["lo"], r["hi"]
        if r["n"] <= FINE or lo == hi:
            break
    rows = live.filter(F.col("finish").between(lo, hi))
    total = F.sum("size").over(W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("total", total).filter(F.col("total") + spent <= budget).agg(F.max(F.struct(*ORDER)).alias("m")).first()["m"]
    if found is not None:
        return tuple(found)
    before = live.filter(F.col("finish") < lo).agg(F.max(F.struct(*ORDER)).alias("m")).first()["m"]
    return tuple(before) if before is not None else ()


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, mix_finish), sorted by range in the order of the mix.

    ``taken`` is what the mix takes of each document, repeats counted, ``mix_finish`` the
    virtual finish time of the first; documents that aren't taken come last.
    """
    queued = cut(queue(docs))
    budget = queued.select("skey", "target").distinct().agg(F.sum("target").alias("t")).first()["t"] or 0.0
    end = last_taken(queued, round(budget, 6))
    inside = _inside(end)
    sent = inside & (F.col("size") > 0) & F.col("finish").isNotNull()
    words, first = F.sum(F.when(sent, F.col("size")).otherwise(0)), F.min(F.when(sent, F.col("finish")))
    found = queued.groupBy("doc_id", "skey", "size", "source_size", "target").agg(words.alias("taken"), first.alias("mix_finish"), (F.count("*") / MOST_TIMES).cast("long").alias("copies"))
    # Rows that repeat doc_id, source and size share what they have sent evenly, the first ones the rest in whole documents.
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    times = F.when(F.col("size") > 0, F.col("taken") / F.greatest("size", F.lit(1))).otherwise(0).cast("long")
    found = found.withColumn("times", times).withColumn("k", k)
    own = F.floor(F.col("times") / F.col("copies")) + F.when(F.col("k") < F.col("times") % F.col("copies"), 1).otherwise(0)
    taken = (own * F.col("size")).cast("long")
    found = found.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(taken > 0, F.col("mix_finish")).alias("mix_finish"))
    return found.orderBy(F.col("mix_finish").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def _inside(end: tuple | None):
    if end is None:
        return F.lit(True)
    if not end:
        return F.lit(False)
    here, there = F.struct(*[F.coalesce(F.col(c), F.lit(-1)) if c == "doc_id" else F.col(c) for c in ORDER]), F.struct(*[F.lit(-1 if v is None else v).cast("double" if c == "finish" else "int" if c == "epoch" else "long" if c == "doc_id" else "string") for c, v in zip(ORDER, end, strict=True)])
    return here <= there


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Documents in the order of the mix, with column ``mix_finish``; a repeated document is there as often as it is taken."""
    queued = cut(queue(docs))
    budget = queued.select("skey", "target").distinct().agg(F.sum("target").alias("t")).first()["t"] or 0.0
    taken = queued.filter(_inside(last_taken(queued, round(budget, 6))) & (F.col("size") > 0) & F.col("finish").isNotNull())
    h, finish = unused(docs, "_h"), unused(docs, "_finish")
    if "mix_finish" in map(str.lower, docs.columns):
        raise ValueError("documents have a column mix_finish already")
    rows = taken.groupBy("h").agg(F.array_sort(F.array_distinct(F.collect_list("finish"))).alias(finish)).withColumnRenamed("h", h)
    out = docs.withColumn(h, place()).join(rows, h).withColumn("mix_finish", F.explode(finish)).drop(finish, h)
    return out.repartitionByRange("mix_finish").sortWithinPartitions("mix_finish", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
r AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS lim, CAST(2 * source_size AS DOUBLE) / weight AS ratio FROM s),
l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) * 150 AS DOUBLE) / 100
             - coalesce(sum(lim) OVER o, 0)) / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER o, 0)) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level FROM l WHERE ratio > level ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM f) = 0 THEN lim ELSE least(lim, (SELECT level FROM f) * weight) END AS target FROM l),
q AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN d.source IS NULL THEN 'n' ELSE 's' || d.source END AS skey,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, epoch, CAST(epoch * source_size + sent AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1]) AS epoch) WHERE target > 0 AND size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, skey, epoch, h, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT doc_id, sum(size) AS taken, min(finish) AS mix_finish FROM c WHERE total <= (SELECT round(sum(target), 6) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, k.mix_finish
FROM q LEFT JOIN k USING (doc_id)
"""
