"""Principal components of a set of images."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from volspark.operators.grid import AXES, Size
from volspark.plans.state import cut

#: Of a Gram matrix: least images and most bytes of a block, blocks of a cohort, products of a batch, and cohorts whose numbers of blocks are sent to all tasks.
BLOCK, BLOCK_BYTES, BLOCKS, PRODUCTS, FEW = 32, 64 << 20, 24, 1 << 17, 10_000


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row (keys, a, b, dot) for each image a of a block and part of another, with the ids and products of that part, of rows (lo, hi, right, image_id, data, keys) sorted by cell, the left block first; the left block of one cell is held."""
    cell, held = None, []

    def out(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, data = part.column(3).to_numpy(zero_copy_only=False), _arrays(part.column(4))
        for left, rows in held:
            step = max(1, PRODUCTS // max(1, len(left)))
            for at in range(0, len(ids), step):
                right = ids[at : at + step]
                dots = rows @ data[at : at + step].T
                # A block meets itself once, and both orders of a pair are in it.
                keep = left[:, None] <= right if cell[0] == cell[1] else np.ones(dots.shape, bool)
                ends = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]), pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.array(x[keep])) for x in (np.broadcast_to(right, keep.shape), dots)]
                yield pa.RecordBatch.from_arrays([*[pa.repeat(part.column(c)[0], len(left)) for c in range(5, part.num_columns)], pa.array(left), *columns], schema=schema)

    for batch in batches:
        lo, hi, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        turns = [lo, hi, right, *[np.array(batch.column(c).dictionary_encode().indices.fill_null(-1)) for c in range(5, batch.num_columns)]]
        ends = np.flatnonzero(np.any([t[1:] != t[:-1] for t in turns], 0)) + 1
        for at, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if at == end:
                continue
            part = batch.slice(at, end - at)
            here = (lo[at], hi[at], *[part.column(c)[0].as_py() for c in range(5, batch.num_columns)])
            if here != cell:
                cell, held = here, []
            if right[at]:
                yield from out(part)
            else:
                held.append((part.column(3).to_numpy(zero_copy_only=False).copy(), _arrays(part.column(4)).copy()))


def gram_matrix(dense: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, dot) of the images of a cohort, a <= b.

    Images are dealt over blocks, BLOCKS a cohort, or fewer of at least BLOCK images,
    or more of at most BLOCK_BYTES, and a pair of blocks is a matrix product in one
    task. An image goes to as many cells as there are blocks, so that what is
    shuffled grows with the images, and only the products with their pairs. Products
    leave a task as lists, which Spark explodes: a row of its own for each costs Python more than they do.
    """
    data = dense.select(*keys, "image_id", F.col("data").cast("array<double>").alias("data"))
    count = F.floor(F.count("*") / BLOCK) + 1
    sizes = data.groupBy(*keys).agg(F.greatest(F.least(count, F.lit(BLOCKS)), F.ceil(F.sum(F.size("data").cast("long") * 8) / BLOCK_BYTES)).cast("int").alias("_blocks"))
    dealt = data.join(F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes, list(keys)).withColumn("own", F.pmod(F.xxhash64("image_id"), "_blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi"), (F.col("own") > o).cast("int").alias("right")))
    # In the cell of a block with itself its images are on both sides.
    cells = dealt.withColumn("c", F.explode(F.concat(others, F.array(F.struct(F.col("own").alias("lo"), F.col("own").alias("hi"), F.lit(1).alias("right"))))))
    rows = cells.select("c.lo", "c.hi", "c.right", F.col("image_id").cast("long").alias("image_id"), "data", *keys)
    kind = StructType([*[rows.schema[k] for k in keys], StructField("a", LongType()), StructField("b", ArrayType(LongType())), StructField("dot", ArrayType(DoubleType()))])
    schema = to_arrow_schema(kind)
    schema = pa.schema([pa.field(f.name, f.type) for f in schema])
    dealt = rows.repartition(*keys, "lo", "hi").sortWithinPartitions(*keys, "lo", "hi", "right")
    lists = dealt.mapInArrow(lambda batches: _products(batches, schema), kind).select(*keys, "a", "b", F.posexplode("dot").alias("_i", "dot"))
    other = F.get("b", F.col("_i"))
    return lists.select(*keys, F.least("a", other).alias("a"), F.greatest("a", other).alias("b"), "dot")


_PART = pa.schema([("part", pa.list_(pa.float64()))])


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum over the images of a task of each image times a number, or its product with a vector (column 1)."""
    total = None
    for batch in batches:
        if batch.num_rows:
            data, v = _arrays(batch.column(0)), _arrays(batch.column(1))
            weights = v[:, 0] if v.shape[1] == 1 else (data * v).sum(1)
            part = weights @ data
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], _PART.types[0])], schema=_PART)


def _summed(rows: DataFrame, factor: float) -> DataFrame:
    """(one, c): one row with the sum over the tasks, times the factor; a task sends one image."""
    parts = rows.mapInArrow(_partial_sums, "part array<double>").select(F.posexplode("part").alias("i", "v"))
    sums = parts.groupBy("i").agg((F.sum("v") * factor).alias("v"))
    return cut(sums.agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("c")).select(F.lit(0).alias("one"), "c"))


def start_vector(k: int, size: Size) -> list[float]:
    """Fixed numbers in [-1/2, 1/2) for the voxels, x fastest."""
    sx, sy, sz = size
    return [((x * 7 + y * 13 + z * 29 + k * 17 + 3) * 7919 % 1009) / 1009 - 0.5 for z in range(sz) for y in range(sy) for x in range(sx)]


def power_components(images: DataFrame, size: Size, count: int, iterations: int = 30) -> list[tuple[float, DataFrame]]:
    """(eigenvalue of X X' / n, one row with the unit component ``c``) by power iteration with deflation.

    Images stay whole rows. An iteration is one pass: every task projects its
    images on the component, which is one image and is sent to all tasks, and
    sends one image, their weighted sum.
    """
    rows = images.select(F.lit(0).alias("one"), F.col("data").cast("array<double>").alias("data"))
    n = rows.count()
    less = lambda r, v, f: r.join(F.broadcast(v), "one").select("one", F.zip_with("data", "c", f).alias("data"))
    rows = cut(less(rows, _summed(rows.select("data", F.array(F.lit(1.0)).alias("c")), 1 / max(n, 1)), lambda x, m: x - m))
    out: list[tuple[float, DataFrame]] = []
    for k in range(count):
        v = images.sparkSession.createDataFrame([(0, start_vector(k, size))], "one int, c array<double>")
        value = 0.0
        for _ in range(iterations):
            w = _summed(rows.join(F.broadcast(v), "one").select("data", "c"), 1 / max(n, 1))
            value = float(np.sqrt(w.select(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)).first()[0] or 0.0))
            if value == 0:
                break
            v = w.withColumn("c", F.transform("c", lambda x: x / value))
        out.append((value, v))
        p = rows.join(F.broadcast(v), "one").withColumn("p", F.aggregate(F.zip_with("data", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
        rows = cut(p.select("one", F.zip_with("data", F.transform("c", lambda x: x * F.col("p")), lambda x, y: x - y).alias("data")))
    return out


def normal_equations_affine(rows: DataFrame) -> DataFrame:
    """(image_id, i, j, s): sums of products of the nine linear terms g_a * x_b, and of each with the residual (j = 9)."""
    terms = [F.col(f"g{a}") * F.col(b) for a in AXES for b in AXES]
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((terms[j] if j < 9 else F.col("residual")) * terms[i]).alias("p")) for i in range(9) for j in range(i, 10)])
    return rows.select("image_id", F.explode(pairs).alias("e")).groupBy("image_id", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum("e.p").alias("s"))
