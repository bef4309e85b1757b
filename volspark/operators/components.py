"""Principal component images of a table of images, several components a pass, images in pieces of voxels.

An image is cut into pieces of ``width`` voxels, so neither an image nor a
component has to fit one row. A pass of orthogonal iteration is two sums: scores
by image (pieces times the components' pieces) and new components by piece (pieces
weighted by scores, added up in each task first). Only the products of components
with each other, count * (count + 1) / 2 numbers, come to the driver.

Images without data are left out; image_id is unique. Of components beyond the rank
of the images, the value and the image are 0. No images give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.plans.state import cut

#: Voxels of a piece.
WIDTH = 4096
#: Bytes of components that are sent to all tasks; larger ones are joined by piece, each piece dealt over SALTS parts.
BROADCAST, SALTS = 64 << 20, 32
#: Doubles of sums that a task holds before it sends them.
HELD = 8 << 20
#: A component whose square is below this part of what it was before those before it were taken away is 0.
NONE = 1e-20


@dataclass(frozen=True)
class Components:
    """(block, c) of the mean, (block, w) of unit components one after the other, their eigenvalues, and the voxels of an image."""

    mean: DataFrame
    images: DataFrame
    values: list[float]
    voxels: int
    width: int


def pieces(images: DataFrame, width: int = WIDTH) -> DataFrame:
    """(image_id, block, data) of (image_id, data)."""
    data = F.col("data").cast("array<double>")
    rows = images.filter(F.size("data") > 0).select("image_id", data.alias("data"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("data") / width).cast("int") - 1), lambda b: F.slice("data", b * width + 1, F.lit(width)))
    return rows.select("image_id", F.posexplode(parts).alias("block", "data"))


def _matched(rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """Pieces with the row of their block, whose table has ``size`` bytes."""
    if size <= BROADCAST:
        return rows.join(F.broadcast(blocks), "block")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("image_id"), F.lit(SALTS)))
    copies = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, ["block", "salt"]).drop("salt")


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _part(w: str, k: int, of: Column) -> Column:
    """The k-th of the components of a block of ``of`` voxels."""
    return F.slice(w, k * of + 1, of)


_SUMS = pa.schema([("block", pa.int64()), ("part", pa.list_(pa.float64()))])


def _weighted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pieces of a task of scores times data, by block; columns block, data, scores."""
    total: dict[int, np.ndarray] = {}

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([t.ravel() for t in total.values()], _SUMS.types[1])], schema=_SUMS)

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for b in np.unique(blocks):
            of = pa.array(np.flatnonzero(blocks == b))
            data, scores = (batch.column(i).take(of).flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1) for i in (1, 2))
            part = scores.T @ data
            total[int(b)] = total[int(b)] + part if int(b) in total else part
        if sum(t.size for t in total.values()) > HELD:
            yield sent()
            total.clear()
    if total:
        yield sent()


def _sums(rows: DataFrame, factor: float, name: str) -> DataFrame:
    """(block, name): sums of (block, data, scores), times the factor."""
    parts = rows.select(F.col("block").cast("long"), "data", "scores").mapInArrow(_weighted, "block long, part array<double>")
    sums = parts.select("block", F.posexplode("part").alias("i", "v")).groupBy("block", "i").agg((F.sum("v") * factor).alias("v"))
    whole = sums.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias(name))
    return cut(whole.select(F.col("block").cast("int").alias("block"), name))


def _changed(w: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Components that are combinations of those of a table (block, w)."""
    count = len(matrix)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(matrix @ np.array(x).reshape(count, -1)).ravel() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["block", "w"])

    return w.select("block", "w").mapInArrow(run, "block int, w array<double>")


def _orthonormal(w: DataFrame, count: int) -> tuple[DataFrame, list[float]]:
    """Unit components in the span of the first, the first two, and so on; and what was left of each."""
    of = (F.size("w") / count).cast("int")
    pairs = [(a, b) for a in range(count) for b in range(a + 1)]
    found = w.select(*[F.sum(_dot(_part("w", a, of), _part("w", b, of))).alias(f"d{a}_{b}") for a, b in pairs]).first()
    gram, change, left = np.zeros((count, count)), np.zeros((count, count)), [0.0] * count
    for (a, b), v in zip(pairs, found, strict=True):
        gram[a, b] = gram[b, a] = v or 0.0
    for k in range(count):
        row = np.eye(count)[k]
        for before in change[:k]:
            row = row - (before @ gram[k]) * before
        square = row @ gram @ row
        if square > NONE * gram[k, k]:
            left[k] = float(np.sqrt(square))
            change[k] = row / left[k]
    return _changed(w, change), left


def _scores(rows: DataFrame, w: DataFrame, count: int, voxels: int) -> DataFrame:
    """(image_id, scores, square): products with the components, and with itself, of each image; partial sums by piece."""
    of = F.size("data")
    each = _matched(rows, w, 8 * count * voxels).select("image_id", _dot("data", "data").alias("n"), *[_dot("data", _part("w", k, of)).alias(f"p{k}") for k in range(count)])
    return each.groupBy("image_id").agg(F.array(*[F.sum(f"p{k}") for k in range(count)]).alias("scores"), F.sum("n").alias("square"))


def _start(count: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fixed numbers in [-1/2, 1/2) for the voxels of (block, c)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(count)[:, None]
        for batch in batches:
            out = []
            for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                i = block * width + np.arange(n)
                out.append((((i * (2 * k + 7) + 17 * k + 3) * 7919 % 1009) / 1009 - 0.5).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["block", "w"])

    return run


def _centred(images: DataFrame, mean: DataFrame, voxels: int, width: int) -> DataFrame:
    return _matched(pieces(images, width), mean, 8 * voxels).select("image_id", "block", F.zip_with("data", "c", lambda x, m: x - m).alias("data"))


def principal_images(images: DataFrame, count: int, iterations: int = 30, width: int = WIDTH) -> Components:
    """The first components of (image_id, data) by orthogonal iteration from fixed numbers; values are those of X' X / n of the centred images."""
    rows = pieces(images, width)
    n = images.filter(F.size("data") > 0).count()
    mean = _sums(rows.withColumn("scores", F.array(F.lit(1.0))), 1 / max(n, 1), "c")
    voxels = int(mean.select(F.sum(F.size("c"))).first()[0] or 0)
    centred = cut(_centred(images, mean, voxels, width))
    w = mean.select("block", F.size("c").alias("n")).mapInArrow(_start(count, width), "block int, w array<double>")
    values = [0.0] * count
    for _ in range(iterations):
        scores = _scores(centred, w, count, voxels).select("image_id", "scores")
        w, values = _orthonormal(_sums(centred.join(scores, "image_id"), 1 / max(n, 1), "w"), count)
    return Components(mean, w, values, voxels, width)


def component_images(found: Components) -> DataFrame:
    """(k, i, c): the voxels of the components."""
    count = len(found.values)
    of = (F.size("w") / count).cast("int")
    each = found.images.select("block", F.posexplode(F.array(*[_part("w", k, of) for k in range(count)])).alias("k", "c"))
    return each.select("k", F.posexplode("c").alias("j", "c"), "block").select("k", (F.col("block") * found.width + F.col("j")).alias("i"), "c")


def projections(images: DataFrame, found: Components) -> DataFrame:
    """(image_id, k, score, error): the part of each image along a component, and the squared distance that the components up to it leave."""
    count = len(found.values)
    scores = _scores(_centred(images, found.mean, found.voxels, found.width), found.images, count, found.voxels)
    error = lambda k: F.greatest(F.col("square") - sum((F.col("scores")[j] * F.col("scores")[j] for j in range(k + 1)), F.lit(0.0)), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col("scores")[k].alias("score"), error(k).alias("error")) for k in range(count)])
    return scores.select("image_id", F.explode(each).alias("e")).select("image_id", "e.*")


def _plus(factor: Column) -> Callable[[Column, Column], Column]:
    return lambda a, b: a + factor * b


def rebuilt(images: DataFrame, found: Components) -> DataFrame:
    """(image_id, block, data): pieces of the mean plus the images' parts along the components."""
    count = len(found.values)
    centred = _centred(images, found.mean, found.voxels, found.width)
    scores = _scores(centred, found.images, count, found.voxels).select("image_id", "scores")
    both = found.mean.join(found.images, "block")
    of = F.size("c")
    out = F.col("c")
    for k in range(count):
        out = F.zip_with(out, _part("w", k, of), _plus(F.col("scores")[k]))
    keys = centred.select("image_id", "block").join(scores, "image_id")
    return _matched(keys, both, 8 * (count + 1) * found.voxels).select("image_id", "block", out.alias("data"))
