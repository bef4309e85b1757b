"""Removal of repeated word sequences by seed and extend.

Every window of ``length`` words has one anchor, the smallest hash of the
``gram``-word sequences inside it (winnowing), so two equal windows meet at
equal anchors. Anchors that two places share are the seeds. Documents are joined
on them: each place sends the words around its anchor, as many on both sides as
a window can reach, and all places of an anchor are extended together, one word
after the other to the left and to the right, where those that still agree stay
together. A place is matched over so many words to the left and to the right as
an earlier document (a smaller doc_id) agrees with, if that makes ``length``
words or more; matches of neighbouring anchors that overlap grow into maximal
repeats, and their words go.

Documents are dealt over blocks by a hash of their id. Each block reduces its
seeds to distinct ones with their surroundings before they are shuffled, and gets
back only its own, so a passage that a third of all documents hold costs one entry
a block, and no pairs of its places are made. Copies of a whole word sequence are
settled by their digest first. Places agree if the 64-bit hash of the anchor and
32 bits of the hash of each word around it agree.

Defined cases: null text has no words; documents with the same doc_id never
remove words from each other; a null doc_id counts as larger than all others;
texts with fewer words than ``length`` keep all of them; an empty table gives
no rows; columns other than doc_id and text are not read; a very long text stays
in one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import byte_texts, ngram_hashes, slices, word_hashes

LENGTH = 13
GRAM = 5
#: Bytes of text in a block, and bytes of text whose anchors go to one bucket.
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 12 << 20

_LAST = (1 << 63) - 1


def _digest(text: bytes) -> tuple[int, bytes]:
    words = text.split()
    return len(words), hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_CLASS = pa.schema([("block", pa.int64()), ("cls", pa.binary()), ("id", pa.int64())])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        digests = [_digest(x)[1] for x in byte_texts(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), batch.column(1)], schema=_CLASS)


class Block:
    """The documents of a block; ``first`` are those that are not copies of a document with a smaller id."""

    def __init__(self, docs: pa.Table, info: pa.Table, length: int, gram: int) -> None:
        self.length, self.gram, self.reach = length, gram, length - gram
        self.ids = docs.column("id").to_numpy()
        self.texts = byte_texts(docs.column("text"))
        found = [_digest(x) for x in self.texts]
        self.n_words = [n for n, _ in found]
        kept = info.column("cls").to_pylist()
        rep = {c: r for c, r in zip(kept, info.column("rep").to_pylist(), strict=True) if c is not None}
        self.copy = [rep.get(c, i) < i for i, (_, c) in zip(self.ids.tolist(), found, strict=True)]
        self.first = [k for k, c in enumerate(self.copy) if not c]
        self.reply = [np.frombuffer(b, np.uint64) for b in info.column("blob").to_pylist() if b]

    def hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        h, counts = word_hashes([self.texts[k] for k in self.first])
        at = 0
        for k, n in zip(self.first, counts.tolist(), strict=True):
            yield k, h[at : at + n]
            at += n

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of a document's anchors, the anchors, hashes of them with their surroundings, and the words with none beyond both ends."""
        at = anchors(h, self.length, self.gram)
        none = np.zeros(self.reach, np.uint64)
        wide = np.concatenate((none, h, none))
        return at, ngram_hashes(h, self.gram)[at], ngram_hashes(wide, self.gram + 2 * self.reach)[at], wide


def anchors(h: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Positions of the grams that are the smallest of a window of ``length`` words, the first of equal ones."""
    if len(h) < length:
        return np.zeros(0, dtype=np.int64)
    g = ngram_hashes(h, gram)
    n = len(h) - length + 1
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, length - gram + 1):
        less = g[j : n + j] < least
        least[less] = g[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at)


def _distinct(values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct values, each with its smallest id, and its largest id."""
    order = np.lexsort((ids, values))
    v = values[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    end = np.concatenate((start[1:], [len(v)])).astype(np.int64) - 1 if len(v) else start
    return order[start], ids[order[end]]


def _joined(parts: list, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("seeds", "places", "ids", "around")]])


def _sent(block: int, buckets: int, seeds: np.ndarray, places: np.ndarray, ids: np.ndarray, around: np.ndarray) -> pa.Table:
    """One row for each bucket with seeds of this block."""
    at = (seeds % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    columns, at = [x[order] for x in (seeds, places, ids, around)], at[order]
    edges = np.searchsorted(at, np.arange(buckets + 1))
    rows = [(b, block, *[x[edges[b] : edges[b + 1]].tobytes() for x in columns]) for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT) if rows else _SENT.empty_table()


def _seeds(docs: pa.Table, info: pa.Table, length: int, gram: int, buckets: int) -> pa.Table:
    """Distinct anchors of a block; ids are 1 where two documents of the block have the anchor."""
    if not docs.num_rows:
        return _SENT.empty_table()
    block = Block(docs, info, length, gram)
    values, ids = [], []
    for k, h in block.hashes():
        v = np.unique(ngram_hashes(h, gram)[anchors(h, length, gram)])
        values.append(v)
        ids.append(np.full(len(v), block.ids[k], dtype=np.int64))
    v, i = _joined(values, np.uint64), _joined(ids, np.int64)
    at, high = _distinct(v, i)
    none = np.zeros((len(at), 0), np.uint8)
    return _sent(docs.column("block")[0].as_py(), buckets, v[at], none, (i[at] < high).astype(np.uint8), none)


_REPLY = pa.schema([("block", pa.int64()), ("blob", pa.binary())])


def _reply(blocks: np.ndarray, values: np.ndarray) -> pa.Table:
    """The values of each block; values may have several columns."""
    if not len(blocks):
        return _REPLY.empty_table()
    order = np.argsort(blocks, kind="stable")
    blocks, values = blocks[order], values[order]
    found, start = np.unique(blocks, return_index=True)
    rows = [(int(b), values[lo:hi].tobytes()) for b, lo, hi in zip(found, start, [*start[1:], len(blocks)], strict=True)]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _REPLY.types, strict=True)], schema=_REPLY)


def _bucket(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return _joined([np.frombuffer(b, kind) for b in table.column(column).to_pylist()], kind)


def _blocks(table: pa.Table) -> np.ndarray:
    return np.repeat(np.array(table.column("block").to_pylist(), dtype=np.int64), [len(b) // 8 for b in table.column("seeds").to_pylist()])


def _shared(table: pa.Table) -> pa.Table:
    """To each block, its anchors that another document has."""
    seeds, several = _bucket(table, "seeds", np.uint64), _bucket(table, "ids", np.uint8)
    order = np.argsort(seeds)
    k = seeds[order]
    same = k[1:] == k[:-1]
    found = several[order].astype(bool)
    found[1:] |= same
    found[:-1] |= same
    return _reply(_blocks(table)[order][found], k[found])


def _around(docs: pa.Table, info: pa.Table, length: int, gram: int, buckets: int) -> pa.Table:
    """Distinct seeds of a block with the words around them, and the smallest id in the block."""
    if not docs.num_rows:
        return _SENT.empty_table()
    block = Block(docs, info, length, gram)
    seeds = np.sort(_joined(block.reply, np.uint64))
    if not len(seeds):
        return _SENT.empty_table()
    reach, found = block.reach, ([], [], [], [])
    beside = np.concatenate((np.arange(reach), np.arange(reach + gram, 2 * reach + gram)))
    for k, h in block.hashes():
        at, anchor, place, wide = block.places(h)
        own = seeds[np.minimum(np.searchsorted(seeds, anchor), len(seeds) - 1)] == anchor
        at = at[own]
        for x, y in zip(found, (anchor[own], place[own], np.full(len(at), block.ids[k], dtype=np.int64), _short(wide[at[:, None] + beside])), strict=True):
            x.append(y)
    seed, place, ids, around = *(_joined(x, t) for x, t in zip(found[:3], (np.uint64, np.uint64, np.int64), strict=True)), np.concatenate([np.zeros((0, 2 * reach), np.uint32), *found[3]])
    one, _ = _distinct(place, ids)
    return _sent(docs.column("block")[0].as_py(), buckets, seed[one], place[one], ids[one], around[one])


def _short(words: np.ndarray) -> np.ndarray:
    """32 bits of words; 0 stands for no word."""
    return np.where(words == 0, 0, (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1))


def _together(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the groups of rows that agree in two columns, each below 2 ** 32."""
    a, b = columns
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def _extended(table: pa.Table, length: int, gram: int) -> pa.Table:
    """To each block, its places that an earlier document agrees with over a window, and which windows these are.

    All places of a seed make a group. A word to the left or to the right splits
    a group into those that have the same one there. A window of l words to the
    left and r to the right is a repeat of an earlier document if one is in the
    same group after l words and after r words.
    """
    reach = length - gram
    seeds, ids = _bucket(table, "seeds", np.uint64), _bucket(table, "ids", np.int64)
    places, blocks = _bucket(table, "places", np.uint64), _blocks(table)
    around = _bucket(table, "around", np.uint32).reshape(-1, 2 * reach)
    whole = np.unique(seeds, return_inverse=True)[1]
    left, right = [whole], [whole]
    for j in range(reach):
        left.append(_together(left[-1], around[:, reach - 1 - j]))
        right.append(_together(right[-1], around[:, reach + j]))
    windows = np.zeros(len(seeds), np.uint64)
    for n in range(reach + 1):
        there = around[:, reach - n] != 0 if n else np.ones(len(seeds), bool)
        if n < reach:
            there = there & (around[:, 2 * reach - n - 1] != 0)
        group = _together(left[n], right[reach - n])
        least = np.full(group.max() + 1, _LAST)
        np.minimum.at(least, group, ids)
        windows |= (there & (least[group] < ids)).astype(np.uint64) << np.uint64(n)
    found = windows > 0
    return _reply(blocks[found], np.stack((places[found], windows[found]), axis=1))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("repeats", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.string())])


def _kept(docs: pa.Table, info: pa.Table, length: int, gram: int, keep_text: bool) -> pa.Table:
    if not docs.num_rows:
        return _OUT.empty_table()
    block = Block(docs, info, length, gram)
    reply = np.concatenate([np.zeros((0, 2), np.uint64), *[x.reshape(-1, 2) for x in block.reply]])
    reply = reply[np.argsort(reply[:, 0], kind="stable")]
    at, place, ids, owner = [], [], [], []
    for k, h in block.hashes():
        p, _, v, _ = block.places(h)
        at.append(p)
        place.append(v)
        ids.append(np.full(len(p), block.ids[k], dtype=np.int64))
        owner.append(np.full(len(p), k, dtype=np.int64))
    at, place, ids, owner = _joined(at, np.int64), _joined(place, np.uint64), _joined(ids, np.int64), _joined(owner, np.int64)
    # An earlier document of the block with the same surroundings has all windows that the text has there.
    one, _ = _distinct(place, ids)
    low = ids[one][np.searchsorted(place[one], place)] < ids
    windows = np.zeros(len(place), np.uint64)
    if len(reply):
        found = np.minimum(np.searchsorted(reply[:, 0], place), len(reply) - 1)
        windows = np.where(reply[found, 0] == place, reply[found, 1], windows)
    windows[low] = (1 << (block.reach + 1)) - 1
    hit = np.flatnonzero(windows)
    at, windows, owner = at[hit], windows[hit], owner[hit]
    edges = np.searchsorted(owner, np.arange(len(block.texts) + 1))
    rows = []
    for k, (doc_id, text) in enumerate(zip(docs.column("doc_id").to_pylist(), block.texts, strict=True)):
        n = block.n_words[k]
        gone = np.zeros(n, dtype=bool)
        if block.copy[k]:
            gone[:] = n >= length
        elif edges[k] < edges[k + 1]:
            p, w = at[edges[k] : edges[k + 1]], windows[edges[k] : edges[k + 1]]
            change = np.zeros(n + 1, dtype=np.int64)
            for j in range(block.reach + 1):
                start = p[(w >> np.uint64(j)) & np.uint64(1) > 0] - j
                start = start[(start >= 0) & (start + length <= n)]
                np.add.at(change, start, 1)
                np.add.at(change, start + length, -1)
            gone = np.cumsum(change)[:n] > 0
        words = text.split()
        if gone.any():
            words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
        edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
        spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()
        kept = b" ".join(words)
        rows.append((doc_id, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans, kept.decode() if keep_text else None))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats, kept_text) for each row of docs.

    repeats are the maximal removed runs [start, end) in words; kept_text is null without ``keep_text``.
    """
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("s")).first()["s"] or 0
    blocks, buckets = size // BLOCK_BYTES + 1, size // BUCKET_BYTES + 1
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("text").cast("string"))
    # Rows without an id are dealt by their text.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    rows = rows.withColumn("block", F.pmod(salt, F.lit(blocks)))
    # Smallest id of each word sequence, by block, so that a sequence with many copies is one row a block.
    digests = rows.select("block", "id", "text").mapInArrow(_classes, "block long, cls binary, id long")
    classes = digests.groupBy("cls", "block").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    first = classes.groupBy("cls").agg(F.min("id").alias("rep"), F.sum("n").alias("n")).filter("n > 1")
    copies = classes.select("cls", "block").join(first, "cls").select("block", "cls", "rep", F.lit(None).cast("binary").alias("blob"))

    def with_blocks(info: DataFrame, f, schema: str) -> DataFrame:
        return rows.groupBy("block").cogroup(info.groupBy("block")).applyInArrow(f, schema)

    def and_copies(reply: DataFrame) -> DataFrame:
        return copies.unionByName(reply.select("block", F.lit(None).cast("binary").alias("cls"), F.lit(None).cast("long").alias("rep"), "blob"))

    sent, back = "bucket long, block long, seeds binary, places binary, ids binary, around binary", "block long, blob binary"
    seeds = with_blocks(copies, lambda a, b: _seeds(a, b, length, gram, buckets), sent)
    shared = seeds.groupBy("bucket").applyInArrow(_shared, back)
    around = with_blocks(and_copies(shared), lambda a, b: _around(a, b, length, gram, buckets), sent)
    matched = around.groupBy("bucket").applyInArrow(lambda t: _extended(t, length, gram), back)
    return with_blocks(and_copies(matched), lambda a, b: _kept(a, b, length, gram, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<array<long>>, kept_text string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 12, 0))) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
r AS (SELECT h.doc_id, h.i FROM h JOIN m USING (k) WHERE m.least < h.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
p AS (SELECT d.doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
