"""Exact deduplication by Grace hashing.

Texts are equal when they are identical without white space. Each task first
merges the copies within its own batches, so that a hot text leaves one record
a batch; the records then go by hash to partitions, and each partition fills an
open-addressing table that compares complete contents. When the table has
reached its memory bound, records of contents that it doesn't hold go to spill
files by further bits of the hash, and each file is processed in the same way.

Defined cases: null text counts as empty, and empty texts are copies of each
other. Of equal texts the one with the most code points stays, then the
smallest doc_id (null ids last). Rows that repeat one doc_id each count in
``group_size`` and share that id's decision. An empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import WHITE, byte_texts, slices

#: Copies of one text are dealt over so many keys when the groups are joined to the rows.
SALTS = 64
#: Bytes of distinct contents that a table holds before records go to spill files.
TABLE_BYTES = 64 << 20
#: Spill files that one bucket is cut into.
FAN = 16


class OpenTable:
    """Open addressing with linear probing; entries are equal when all of their content is."""

    def __init__(self, bits: int = 10) -> None:
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.size = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry, slot); entry is -1 if the content isn't there, and slot is where it belongs."""
        mask = len(self.slots) - 1
        at = h & mask
        while (k := int(self.slots[at])) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, at
            at = (at + 1) & mask
        return -1, at

    def add(self, h: int, content: bytes, value: list, slot: int) -> None:
        self.slots[slot] = len(self.values)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.size += len(content) + 200
        if 2 * len(self.values) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
            mask = len(self.slots) - 1
            for k, x in enumerate(self.hashes):
                at = x & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k


def _better(a: list, n: int, doc_id: int | None) -> bool:
    """Whether (n, doc_id) is to stay rather than the one that a holds."""
    if n != a[0]:
        return n > a[0]
    return doc_id is not None and (a[1] is None or doc_id < a[1])


def merge(table: OpenTable, k: int, n: int, doc_id: int | None, count: int, salts: int) -> None:
    a = table.values[k]
    if _better(a, n, doc_id):
        a[0], a[1] = n, doc_id
    a[2] += count
    a[3] |= salts


def grace(records: Iterator[tuple], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[bytes, list]]:
    """Groups of equal contents of (hash, content, n, doc_id, count, salts); the hash has 128 bits."""
    table = OpenTable()
    files: list = []
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for r in records:
            h, content, n, doc_id, count, salts = r
            k, slot = table.find(h & 0x7FFFFFFFFFFFFFFF, content)
            if k >= 0:
                merge(table, k, n, doc_id, count, salts)
            elif table.size < table_bytes or level > 28:
                table.add(h & 0x7FFFFFFFFFFFFFFF, content, [n, doc_id, count, salts], slot)
            else:
                if not files:
                    files = [open(f"{folder}/{i}", "wb+") for i in range(FAN)]  # noqa: SIM115
                pickle.dump(r, files[(h >> (124 - 4 * level)) % FAN])
        yield from zip(table.contents, table.values, strict=True)
        del table
        for f in files:
            f.seek(0)
            yield from grace(_load(f), table_bytes, level + 1)
            f.close()


def _load(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


_RECORD = pa.schema([("part", pa.int64()), ("h", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("best_id", pa.int64()), ("rows", pa.int64()), ("salts", pa.int64())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each distinct content of a batch; rows without an id are dealt over all salts."""
    every = (1 << SALTS) - 1
    for batch in slices(batches, "text"):
        table = OpenTable()
        digests: list[bytes] = []
        texts = batch.column(1).to_pylist()
        for doc_id, text, raw, salt in zip(batch.column(0).to_pylist(), texts, byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            content = raw.translate(None, WHITE)
            digest = hashlib.blake2b(content, digest_size=16).digest()
            h = int.from_bytes(digest, "big") & 0x7FFFFFFFFFFFFFFF
            k, slot = table.find(h, content)
            if k >= 0:
                merge(table, k, len(text or ""), doc_id, 1, every if doc_id is None else 1 << salt)
            else:
                table.add(h, content, [len(text or ""), doc_id, 1, every if doc_id is None else 1 << salt], slot)
                digests.append(digest)
        rows = [(int.from_bytes(d[:8], "big", signed=True), d, c, v[0], v[1], v[2], _signed(v[3])) for d, c, v in zip(digests, table.contents, table.values, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD) if rows else pa.RecordBatch.from_pylist([], schema=_RECORD)


_GROUP = pa.schema([("text_sha256", pa.string()), ("salt", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _groups(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Groups of more than one row, once for each salt that its rows have."""

    def records() -> Iterator[tuple]:
        for batch in slices(batches, "content"):
            for h, content, n, doc_id, count, salts in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                yield int.from_bytes(h, "big"), content, n, doc_id, count, salts & ((1 << 64) - 1)

    rows = []
    for content, (_, keep, count, salts) in grace(records(), table_bytes):
        if count > 1:
            sha = hashlib.sha256(content).hexdigest()
            rows += [{"text_sha256": sha, "salt": s, "keep_id": keep, "group_size": count} for s in range(SALTS) if salts >> s & 1]
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema=_GROUP)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema=_GROUP)


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    any_salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(salt)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    records = rows.withColumn("salt", salt).mapInArrow(_records, "part long, h binary, content binary, n long, best_id long, rows long, salts long")
    groups = records.repartition("part").mapInArrow(lambda it: _groups(it, table_bytes), "text_sha256 string, salt long, keep_id long, group_size long")
    bare = F.translate(F.coalesce("text", F.lit("")), WHITE.decode(), "")
    members = rows.select("doc_id", F.sha2(bare, 256).alias("text_sha256"), any_salt.alias("salt"))
    return members.join(groups, ["text_sha256", "salt"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
