"""What the corpus operators share: hashing of words, folds, checkpoints, id filters."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D].
WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
#: Word bytes hashed at once; a single word of this length or more is hashed on its own.
CHUNK = 1 << 18
#: Bytes of values that a broadcast table may hold, counted before; beyond it the join is by shuffle.
BROADCAST_BYTES = 16_000_000
#: Bytes of a batch that goes to Python.
ARROW_BYTES = 8 << 20

_M64 = (1 << 64) - 1
_BASE = 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class _Tables:
    """Powers of the base and byte values, built once in each worker."""

    def __init__(self) -> None:
        up = np.full(CHUNK + 1, _BASE, dtype=np.uint64)
        down = np.full(CHUNK + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.white = np.zeros(256, dtype=bool)
        self.white[list(WHITE)] = True


_tables: _Tables | None = None


def _get() -> _Tables:
    global _tables
    if _tables is None:
        _tables = _Tables()
    return _tables


def _hash_piece(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of at most CHUNK bytes."""
    t = _get()
    a = np.frombuffer(piece, dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], t.white[a], [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(t.byte[a] * t.up[: len(a)], out=total[1:])
    return start, mix((total[end] - total[start]) * t.down[start])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of at most CHUNK bytes, cut at white space; a giant word alone."""
    at = 0
    while at < len(text):
        if len(text) - at <= CHUNK:
            yield text[at:]
            return
        cut = max(text.rfind(bytes([c]), at, at + CHUNK) for c in WHITE)
        if cut < 0:
            found = re.compile(rb"[\x09-\x0d\x20]").search(text, at + CHUNK)
            cut = found.start() if found else len(text)
            yield text[at:cut]
            at = cut
        else:
            yield text[at : cut + 1]
            at = cut + 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words of each text.

    Words are maximal runs without white space; equal words have equal hashes
    wherever they stand.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    at = 0
    while at < len(texts):
        if len(texts[at]) >= CHUNK:
            for piece in _pieces(texts[at]):
                if len(piece) >= CHUNK and not any(c in piece for c in WHITE):
                    h = np.frombuffer(hashlib.blake2b(piece, digest_size=8).digest(), dtype=np.uint64)
                else:
                    h = _hash_piece(piece)[1]
                hashes.append(h)
                counts[at] += len(h)
            at += 1
            continue
        first, size = at, 0
        while at < len(texts) and size + len(texts[at]) + 1 <= CHUNK:
            size += len(texts[at]) + 1
            at += 1
        start, h = _hash_piece(b"\n".join(texts[first:at]))
        offsets = np.cumsum([len(x) + 1 for x in texts[first:at]])
        counts[first:at] = np.bincount(np.searchsorted(offsets, start, side="right"), minlength=at - first)
        hashes.append(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), counts


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ** 3 | 1) & _M64)
    return mix(out)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each part has about ``most`` bytes of text and ``rows`` rows at most."""
    for batch in batches:
        n, size = batch.num_rows, batch.column(batch.schema.get_field_index(column)).nbytes
        step = min(rows, n if size <= most else max(1, n * most // size))
        for at in range(0, n, max(1, step)):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Return the memory that a task has freed to the machine, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids are in no fold (-1)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(k), F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where Spark runs in one process and none is set."""
    sc = spark.sparkContext
    jsc = sc._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="volspark-checkpoint-"))
    return jsc.getCheckpointDir().get()


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send ARROW_BYTES at once to Python, and give their shuffle files up when they end."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later reads don't repeat its lineage, and nothing of it is left but the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with frugal(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete the files of tables that cut() has written and nothing reads any more."""
    for table in tables:
        if (path := getattr(table, "_written_at", None)) is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id isn't in ids (distinct, cheap to count); a null doc_id stays."""
    return df.join(by_size(ids), "doc_id", "left_anti")


def by_size(table: DataFrame, width: int | None = None) -> DataFrame:
    """The table, to be broadcast if it is counted to have BROADCAST_BYTES at most.

    A row counts 8 bytes for each column, or ``width`` bytes where a column has
    a length of its own, which the caller knows.
    """
    wide = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    if wide and width is None:
        raise ValueError(f"the width of {wide} must be given")
    most = BROADCAST_BYTES // (width or 8 * len(table.columns))
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prefix_sums(rows: DataFrame, keys: list[str], bucket: str, value: str, name: str, fan: int = 1024) -> DataFrame:
    """Sum of ``value`` over the smaller buckets of the same keys, for each (keys, bucket).

    rows has one row for each (keys, bucket) at most. Buckets are added up in two
    levels, so that no window holds more than max(fan, buckets / fan) rows.
    """
    from pyspark.sql import Window as W

    top = F.shiftright(F.col(bucket), int(np.log2(fan)))
    rows = rows.withColumn("_top", top)
    uppers = rows.groupBy(*keys, "_top").agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*keys).orderBy("_top").rowsBetween(W.unboundedPreceding, -1)
    uppers = uppers.select(*keys, "_top", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    inner = W.partitionBy(*keys, "_top").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return rows.join(uppers, [*keys, "_top"]).select(*keys, bucket, (F.col("_in") + F.col("_base")).alias(name))


def bucket_bits(n: int, rows: int = 2000) -> int:
    """Bits of a hash so that n rows fall into buckets of about ``rows`` rows."""
    return max(0, int(np.ceil(np.log2(max(1, n / rows)))))


def ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows dealt by range of ``order``, with ``part``, the number of the range; written out.

    Rows that are equal in order may fall into several ranges, so no range grows with them.
    """
    tagged = rows.withColumn("_row", F.monotonically_increasing_id())
    return cut(tagged.repartitionByRange(*order, F.col("_row").asc()).withColumn("part", F.spark_partition_id()).drop("_row"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows numbered from 1 in order, each number within its range and the sizes of the ranges before it."""
    from pyspark.sql import Window as W

    dealt = ranged(rows, order)
    # One row a range, so the window without keys holds as many rows as the shuffle has partitions.
    before = F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part").agg(F.count("*").alias("_n")).select("part", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(offsets), "part").withColumn(name, F.col("_before") + F.col("_place")).drop("part", "_place", "_before")


def unused(df: DataFrame, name: str) -> str:
    """A name like this one that no column of the table has."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name
