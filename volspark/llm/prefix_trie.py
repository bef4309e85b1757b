"""The prefix trie of rebuilt conversations, summed up by leaf-peeling message passing.

A node is a distinct sequence of first turns. Its key is the exclusive or of 120
bits a turn (SHA-256 of place, role and text), so keys of prefixes are running
sums: they are made within ranges of sorted turns, and a table of one row for
each (conversation, range) carries them over. A conversation may therefore be
as long as it likes.

Nodes that have the same members follow each other in a chain, and a chain is
known by (smallest member, number of members) alone: nodes with one smallest
member lie on its path, and members only get fewer on the way down. Chains are
the nodes that messages pass between: each counts the chains below it that
haven't reported, and when none is left, sends its subtree's leaves and savings
to the chain above, summed by receiver before they are shuffled; rounds end
when only the root is done. What a node within a chain adds is a running sum.

Defined cases: a null conv_id is no conversation; null role and text count as
empty; equal turns stand in the order of the first 32 characters of role and of
text, then of the hash of both; repeated rows are turns of their own; an empty
table has no nodes, not even a root, as no conversation is its member; columns
other than conv_id, turn, role and text are not read. Where nothing precedes a
turn, the remainder of a negative conv_id has its sign, as in SQL. Rounds are at
most the longest path of chains, which branch or end a conversation each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.llm.common import cut, drop, prefix_sums, ranged

#: A conversation takes over this many turns at most, one less than the modulus of its id's crc32.
HEADS = 6
#: Conversations of this many consecutive ids take over turns of the first of them.
SHARED = 100
#: Nodes of a chain that one window sums up.
SPAN = 1024
#: Bytes of ids of a node that are joined in one string.
CHUNK = 1 << 18

KEY = ["depth", "ka", "kb"]
CHAIN = ["conv_id", "n_convs"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("r").asc(), F.col("t").asc(), F.col("digest").asc()]


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, digest, chars): turns numbered from 1, with the range that they fell into; written out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(role, 1, 32).alias("r"), F.substring(text, 1, 32).alias("t"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    dealt = ranged(turns, [F.col("conv_id").asc(), *_order()])
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", before.alias("before"))
    pos = F.col("before") + F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*_order()))
    out = cut(dealt.join(offsets, ["conv_id", "part"]).select("conv_id", "part", pos.alias("pos"), "digest", "chars"))
    drop(dealt)
    return out


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, part, depth, la, lb, chars) of the rebuilt conversations and (conv_id, n_turns) of all, both written out."""
    own = turns.groupBy("conv_id", "part").agg(F.max("pos").alias("last"))
    ids = own.groupBy("conv_id").agg(F.max("last").alias("n"))
    ids = ids.withColumn("h", F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % F.lit(HEADS)).withColumn("base", F.col("conv_id") - F.col("conv_id") % F.lit(SHARED))
    heads = turns.filter(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("heads"))
    taken = F.when(F.col("heads").isNotNull(), F.slice("heads", F.lit(1), F.col("h").cast("int"))).otherwise(F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>"))
    ids = cut(ids.join(heads, "base", "left").withColumn("taken", taken).select("conv_id", "n", "h", "taken", F.size("taken").cast("long").alias("n_taken")))
    first = ids.select("conv_id", F.lit(-1).alias("part"), F.explode("taken").alias("x")).select("conv_id", "part", F.col("x.pos").alias("depth"), "x.digest", "x.chars")
    shifts = own.join(ids.select("conv_id", "h", "n_taken"), "conv_id").select("conv_id", "part", "h", "n_taken")
    rest = turns.join(shifts, ["conv_id", "part"]).filter(F.col("pos") > F.col("h")).select("conv_id", "part", (F.col("pos") - F.col("h") + F.col("n_taken")).alias("depth"), "digest", "chars")
    both = first.unionByName(rest).withColumn("s", F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256))
    lane = lambda at: F.conv(F.substring("s", at, 15), 16, 10).cast("long")
    rows = cut(both.select("conv_id", "part", "depth", lane(1).alias("la"), lane(17).alias("lb"), "chars"))
    sizes = cut(ids.select("conv_id", (F.col("n_taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    drop(ids)
    return rows, sizes


def members(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, chars): the node and its parent's key for each turn of each conversation; written out."""
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("la").alias("xa"), F.bit_xor("lb").alias("xb"))
    carried = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0).cast("long")).alias(c) for x, c in (("xa", "ca"), ("xb", "cb"))])
    so_far = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    keyed = rows.join(carried, ["conv_id", "part"]).withColumn("ka", F.bit_xor("la").over(so_far).bitwiseXOR(F.col("ca"))).withColumn("kb", F.bit_xor("lb").over(so_far).bitwiseXOR(F.col("cb")))
    return cut(keyed.select("conv_id", *KEY, F.col("ka").bitwiseXOR(F.col("la")).alias("pa"), F.col("kb").bitwiseXOR(F.col("lb")).alias("pb"), "chars"))


def _root_key() -> list[Column]:
    return [F.lit(0).cast("long").alias(k) for k in KEY]


def nodes(of: DataFrame, sizes: DataFrame) -> DataFrame:
    """(depth, ka, kb, conv_id, n_convs, chars, pa, pb) of all nodes, the root included; written out."""
    found = of.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    return cut(found.unionByName(root.select(*_root_key(), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), none.alias("pa"), none.alias("pb"))))


def chains(of: DataFrame) -> DataFrame:
    """(conv_id, n_convs, top, bottom, weight, up_conv, up_n, n_below): chains with the chain above, null for the root's; written out."""
    own = of.groupBy(*CHAIN).agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("weight"), F.min_by(F.struct("pa", "pb"), "depth").alias("p"))
    above = of.select((F.col("depth") + 1).alias("top"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"))
    linked = cut(own.select(*CHAIN, "top", "bottom", "weight", "p.pa", "p.pb").join(above, ["top", "pa", "pb"], "left").drop("pa", "pb"))
    below = linked.filter("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("n_below"))
    out = cut(linked.join(below, CHAIN, "left").withColumn("n_below", F.coalesce("n_below", F.lit(0).cast("long"))))
    drop(linked)
    return out


def peel(linked: DataFrame) -> DataFrame:
    """Chains with n_leaves and saved_below, what the chains below them add up to.

    A round takes the chains whose counter is zero, sums what they send by
    receiver, and lowers the receivers' counters; only chains that still wait
    are read and written again.
    """
    zero = F.lit(0).cast("long")
    waiting = linked.withColumn("remaining", F.col("n_below")).withColumn("leaves", zero).withColumn("below", zero)
    done: list[DataFrame] = []
    while True:
        ready = cut(waiting.filter("remaining = 0").withColumn("leaves", F.when(F.col("n_below") == 0, 1).otherwise(F.col("leaves")).cast("long")))
        done.append(ready)
        sent = ready.filter("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"))
        sent = sent.agg(F.count("*").alias("_n"), F.sum("leaves").alias("_leaves"), F.sum(F.col("below") + F.col("weight")).alias("_below"))
        left = waiting.filter("remaining > 0").join(sent, CHAIN, "left").select(
            *linked.columns,
            (F.col("remaining") - F.coalesce("_n", zero)).alias("remaining"),
            (F.col("leaves") + F.coalesce("_leaves", zero)).alias("leaves"),
            (F.col("below") + F.coalesce("_below", zero)).alias("below"),
        )
        left = cut(left)
        drop(waiting)
        waiting = left
        if waiting.isEmpty():
            break
    spark = linked.sparkSession
    return spark.read.schema(done[0].schema).parquet(*[d._written_at for d in done])


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, ka, kb, conv_id) to (depth, ka, kb, conv_id of the first, the ids joined), CHUNK bytes at most."""
    key, first, ids, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, first)] + [pa.array([",".join(ids)], pa.string())], names=[*KEY, "conv_id", "ids"])

    for batch in batches:
        for *k, c in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if k != key or size > CHUNK:
                if ids:
                    yield row()
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (depth, ka, kb, ends_sha256), one chunk at a time."""
    key, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for *k, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if k == key:
                state.update(b"," + ids.encode())
            else:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])


def ends(of: DataFrame, sizes: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of the nodes that conversations end at.

    The ids of a node are sorted by range over all nodes and joined in chunks, so
    only a node's chunks meet in a task, which reads them one after the other.
    """
    last = of.join(sizes, "conv_id").filter(F.col("depth") == F.col("n_turns")).select(*KEY, "conv_id")
    bare = sizes.filter("n_turns = 0").select(*_root_key(), "conv_id")
    rows = last.unionByName(bare)
    chunks = rows.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_chunks, "depth long, ka long, kb long, conv_id long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").mapInArrow(_hashed, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    turns = positions(conversations)
    rows, sizes = rebuild(turns)
    drop(turns)
    of = members(rows, sizes)
    drop(rows)
    trie = nodes(of, sizes)
    linked = chains(trie)
    peeled = peel(linked)
    drop(linked)
    ended = cut(ends(of, sizes))
    drop(of, sizes)

    own = (F.col("n_convs") - 1) * F.col("chars")
    every = trie.join(peeled.select(*CHAIN, "top", "bottom", "up_conv", "n_below", "leaves", "below"), CHAIN).withColumn("own", own).withColumn("r", F.shiftright(F.col("bottom") - F.col("depth"), SPAN.bit_length() - 1))
    inside = F.sum("own").over(W.partitionBy(*CHAIN, "r").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0))
    long = every.filter(F.col("bottom") - F.col("top") >= SPAN).groupBy(*CHAIN, "r").agg(F.sum("own").alias("own"))
    deeper = prefix_sums(long, CHAIN, "r", "own", "deeper")
    every = every.withColumn("inside", inside).join(deeper, [*CHAIN, "r"], "left").join(ended, KEY, "left")
    return every.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("bottom"), 1).otherwise(F.col("n_below")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("below") + F.col("inside") + F.coalesce("deeper", F.lit(0))).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


#: crc32 of an ASCII string in SQL, by a table that is made from the polynomial.
_CRC_TABLE = "tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)))"

ORACLE = (
    f"WITH {_CRC_TABLE},"
    + r"""
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id), tab),
r AS (
  SELECT c.conv_id, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text FROM c JOIN o USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE o.pos > c.h),
k AS (
  SELECT conv_id, pos, length(text) AS chars, sha256(array_to_string(list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos), ',')) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
p AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY pos) AS up, pos = max(pos) OVER (PARTITION BY conv_id) AS ended FROM k),
n AS (
  SELECT node, min(conv_id) AS conv_id, min(pos) AS depth, min(up) AS up, count(*) AS n_convs, min(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends
  FROM p GROUP BY node),
m AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n d WHERE d.up = n.node) AS n_children FROM n LEFT JOIN n u ON u.node = n.up),
s AS (
  SELECT a.node, sum((m.n_convs - 1) * m.chars) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves
  FROM m JOIN k a ON a.conv_id = m.conv_id AND a.pos <= m.depth GROUP BY a.node)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, CAST(parent_conv_id AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
       CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM m JOIN s USING (node)
"""
)
