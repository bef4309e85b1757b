"""Importance resampling of documents towards a target distribution, by hashed n-grams.

A word's CRC-32 is computed once. The CRC of an n-gram is put together from those
of its words: the CRC of what stands before is multiplied by the matrix over
GF(2) that shifts it by the next word's length, and the word's own CRC is added.
So no n-gram is ever built as a string. Counts by bucket are summed within each
task, so a task sends one row a bucket at most; the gains of the buckets (a fixed
number) go to the tasks that weigh the documents. Gumbel noise by document turns
the draw into the highest scores, which are numbered by ranges.

Defined cases: null text has no words; a text without words has weight 0, like one
whose gains add up to 0; a null doc_id counts as the empty string in the noise and
comes last among ties; repeated rows are documents of their own, so equal rows
share a score and have ranks next to each other; target texts may be null or empty;
without any document the result is empty; columns other than doc_id and text are
not read. Long texts are read in parts of PART bytes that end between words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import byte_texts, cut, numbered, slices

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words, as UTF-8 after A-Z became lower case: digits, letters and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text that are searched for words at once.
PART = 1 << 20
#: Words whose CRC a worker remembers, of at most LONG bytes each.
REMEMBERED, LONG = 1 << 18, 64

Matrix = np.ndarray


def _zero_byte() -> Matrix:
    """Columns of the matrix that appends a zero byte to what a CRC covers."""
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        columns.append(c)
    return np.array(columns, dtype=np.uint32)


def _tables(m: Matrix) -> np.ndarray:
    """(4, 256): what each byte of a CRC becomes."""
    out = np.zeros((4, 256), dtype=np.uint32)
    values = np.arange(256)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> bit % 8 & 1, m[bit], np.uint32(0)).astype(np.uint32)
    return out


def _times(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The matrix of the tables times each CRC."""
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


class Shifts:
    """Matrices of shifts by every length: one table each for lengths under LONG, products of powers of two beyond."""

    def __init__(self) -> None:
        one = _zero_byte()
        first, m = _tables(one), np.uint32(1) << np.arange(32, dtype=np.uint32)
        short = []
        for _ in range(LONG):
            short.append(_tables(m))
            m = _times(first, m)
        self.short, self.powers, m = np.stack(short), [], one
        for _ in range(40):
            self.powers.append(_tables(m))
            m = _times(self.powers[-1], m)

    def __call__(self, c: np.ndarray, length: np.ndarray) -> np.ndarray:
        near = np.minimum(length, LONG - 1)
        t = self.short
        out = t[near, 0, c & 255] ^ t[near, 1, c >> 8 & 255] ^ t[near, 2, c >> 16 & 255] ^ t[near, 3, c >> 24]
        if len(far := np.flatnonzero(length >= LONG)):
            x, n = c[far], length[far]
            for k, tables in enumerate(self.powers):
                if not (n >> k).any():
                    break
                x = np.where(n >> k & 1, _times(tables, x), x)
            out[far] = x
        return out


class _Words(dict):
    """length << 32 | CRC of words."""

    def __missing__(self, word: bytes) -> int:
        packed = len(word) << 32 | zlib.crc32(word)
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


_shifts: Shifts | None = None
_words = _Words()


def word_crcs(text: bytes) -> np.ndarray:
    """length << 32 | CRC of each word of a text."""
    text = text.lower()
    found, at = [], 0
    while at < len(text):
        gap = GAP.search(text, at + PART) if len(text) - at > PART else None
        end = gap.start() if gap else len(text)
        words = WORD.findall(text, at, end)
        found.append(np.fromiter(map(_words.__getitem__, words), np.int64, len(words)))
        at = end
    return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.int64)


def features(texts: list[bytes], orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``orders`` words, the text that each is of, and the number of words of each text."""
    global _shifts
    _shifts = _shifts or Shifts()
    found = [word_crcs(t) for t in texts]
    counts = np.array([len(f) for f in found], dtype=np.int64)
    packed = np.concatenate(found) if found else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    crc, length = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32
    all_buckets, all_of, run = [crc % np.uint32(buckets)], [of], crc
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(len(crc), dtype=np.int64)
    for n in range(1, orders):
        before = run[:-1]
        run = _shifts(_shifts(before, one[: len(before)]) ^ space, length[n:]) ^ crc[n:]
        whole = of[n:] == of[: len(of) - n]
        all_buckets.append((run % np.uint32(buckets))[whole])
        all_of.append(of[n:][whole])
    return np.concatenate(all_buckets).astype(np.int64), np.concatenate(all_of), counts


def _count(batches: Iterable[pa.RecordBatch], orders: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, dtype=np.int64)
    for batch in slices(batches, "text", rows=1 << 12):
        total += np.bincount(features(byte_texts(batch.column(0)), orders, buckets)[0], minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, orders: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket; ``buckets`` rows at most come to the driver."""
    rows = texts.select("text").mapInArrow(partial(_count, orders=orders, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of target to source frequency, both smoothed by one."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([np.floor(1000 * np.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _weigh(batches: Iterable[pa.RecordBatch], orders: int, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", rows=1 << 12):
        bucket, of, words = features(byte_texts(batch.column(1)), orders, len(gain))
        n = np.bincount(of, minlength=len(words))
        # Sums of whole numbers below 2 ** 53, exact as doubles.
        total = np.bincount(of, gain[bucket], minlength=len(words)).astype(np.int64)
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return docs.select("doc_id", "text").mapInArrow(partial(_weigh, orders=orders, gain=gain), kind)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, orders: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document.

    ``percent`` of the documents with ``least_words`` words or more are drawn, by the
    highest score of weight and noise, ties to the smaller doc_id; others have no rank.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = cut(weights(docs, target, orders, buckets).withColumn("score", F.col("weight") + noise))
    may = scored.filter(F.col("n_words") >= least_words)
    drawn = may.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_words").asc(), F.col("n_features").asc()]
    ranked = numbered(may, order, "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("place").select(*short.columns).unionByName(short)


ORACLE = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
w AS MATERIALIZED (
  SELECT kind, id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 'd' AS kind, row_number() OVER () AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark)),
f AS MATERIALIZED (
  SELECT kind, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
b AS MATERIALIZED (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f), tab),
n AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN b USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))::DOUBLE)) AS BIGINT) AS gain FROM n),
m AS (SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY id),
d AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS id, doc_id FROM documents) JOIN (SELECT id, words FROM w WHERE kind = 'd') USING (id) LEFT JOIN m USING (id)),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_words, n_features) END AS place FROM d)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM d WHERE n_words >= 20) * 25 // 100 THEN CAST(place AS BIGINT) END AS rank
FROM r
"""
