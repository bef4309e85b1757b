"""Chains of transforms: affine maps, shifts and fields of displacements, forwards or backwards, as one look-up.

A chain takes the place of each voxel through its steps and samples the image once
at the end, so that an image isn't smoothed again by each step. Places are tiles
(``tiles``): affine steps are expressions on them, a field step is a gather, and
the inverse of a field is the fixed point y = p - u(y), looked up again in the tile
that a place stays in, so that places are sent once and those that leave their tile again.
Points go through the same steps by joins with the cubes of voxels that they fall into.

Beyond the grid a field counts as that of its nearest voxel. Null coordinates of a
point give null; a point of an image without a field gives null after a field step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from volspark.operators import tiles
from volspark.operators.fields import U
from volspark.operators.grid import AXES, Size
from volspark.operators.interp import PLACE
from volspark.operators.pointwise import inverse_affine
from volspark.operators.tiles import KEY, Geometry, Tiling
from volspark.plans.state import cut, joined

#: Side of the cubes that points are looked up in, bytes of them that are sent to all tasks, and points of an image that go to one task otherwise.
SIDE, BROADCAST, PART = 8, 64 << 20, 1 << 20


@dataclass(frozen=True)
class Affine:
    """p -> matrix p + shift, in voxels; the matrix by rows."""

    matrix: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    inverse: bool = False

    def numbers(self) -> tuple[Sequence[float], Sequence[float]]:
        return inverse_affine(self.matrix, self.shift) if self.inverse else (self.matrix, self.shift)

    def of(self, x: Column, y: Column, z: Column) -> list[Column]:
        m, t = self.numbers()
        return [x * float(m[3 * k]) + y * float(m[3 * k + 1]) + z * float(m[3 * k + 2]) + float(t[k]) for k in range(3)]

    def along(self, k: int) -> Callable[[Column], Column]:
        """The k-th coordinate of a struct of places."""
        return lambda s: self.of(*[s[c] for c in PLACE])[k]


@dataclass(frozen=True)
class Field:
    """p -> p + u(p), of the named columns of the table of fields."""

    names: tuple[str, str, str] = U
    inverse: bool = False
    iterations: int = 10


Step = Affine | Field


def inverted(steps: Sequence[Step]) -> list[Step]:
    """The steps that lead back."""
    return [replace(s, inverse=not s.inverse) for s in reversed(steps)]


def places(images: DataFrame, fields: DataFrame | None, steps: Sequence[Step], grid: Tiling, of: Tiling | None = None) -> DataFrame:
    """(image_id, tile, px, py, pz): where the voxels of ``of`` (the grid, if not given) go, for each image_id of ``images``."""
    of = of or grid
    p = tiles.regular(images, Geometry(of), Geometry(of))
    held: dict[tuple[str, ...], DataFrame] = {}
    for step in steps:
        if isinstance(step, Affine):
            p = p.select(*KEY, *[F.transform(F.arrays_zip(*PLACE), step.along(k)).alias(c) for k, c in enumerate(PLACE)])
            continue
        if fields is None:
            raise ValueError("a chain with a field step needs a table of fields")
        # Borders of a field are exchanged once, for all its look-ups.
        if step.names not in held:
            held[step.names] = cut(tiles.blocks(fields, grid, step.names))
        p = cut(tiles.moved(held[step.names], p, grid, -1.0 if step.inverse else 1.0, of, step.iterations if step.inverse else 1))
    return p


def apply(images: DataFrame, fields: DataFrame | None, steps: Sequence[Step], grid: Tiling, names: Sequence[str] = ("v",), of: Tiling | None = None, background: float = 0.0) -> DataFrame:
    """Tiles of the images at the places of a chain, sampled once."""
    return tiles.gather(images, places(images, fields, steps, grid, of), grid, names, PLACE, background=background, of=of or grid)


def _held(voxels: DataFrame, names: Sequence[str], size: Size, side: int) -> DataFrame:
    """(image_id, tile, *names): voxels (image_id, x, y, z, *names) in cubes of ``side`` and one voxel beyond it, x fastest; null where there is no voxel."""
    grid, width = Tiling(size, side), [min(side + 1, n) for n in size]
    at = [F.col(a).cast("int") for a in AXES]
    inside = reduce(lambda a, b: a & b, [c.between(0, n - 1) for c, n in zip(at, size, strict=True)])
    # A voxel on the first layer of a cube is also the border of the cube before.
    own = [F.when((c % side == 0) & (c > 0), F.array(F.floor(c / side).cast("int"), (F.floor(c / side) - 1).cast("int"))).otherwise(F.array(F.floor(c / side).cast("int"))) for c in at]
    rows = voxels.filter(inside)
    for k, t in enumerate(own):
        rows = rows.withColumn(f"_t{k}", F.explode(t))
    tile = [F.col(f"_t{k}") for k in range(3)]
    i = [c - t * side for c, t in zip(at, tile, strict=True)]
    cell = F.struct((i[0] + width[0] * (i[1] + width[1] * i[2])).alias("i"), *[F.col(n).cast("double").alias(n) for n in names])
    cubes = rows.groupBy("image_id", grid.number(tile).cast("int").alias("tile")).agg(F.collect_list(cell).alias("c"))
    flat = cubes.select("image_id", "tile", F.col("c.i").alias("i"), *[F.col(f"c.{n}").alias(n) for n in names])
    kind = to_arrow_schema(flat.drop("i").schema)
    n = math.prod(width)

    def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            cells = batch.column(2)
            where = cells.flatten().to_numpy() + np.repeat(np.arange(rows) * n, np.diff(cells.offsets.to_numpy()))
            columns = []
            for k in range(3, batch.num_columns):
                values = batch.column(k).flatten()
                out, known = np.zeros(rows * n), np.zeros(rows * n, bool)
                out[where], known[where] = values.fill_null(0.0).to_numpy(), values.is_valid().to_numpy(zero_copy_only=False)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(out, mask=~known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(kind, [batch.column(0), batch.column(1), *columns], strict=True)]))

    return flat.mapInArrow(filled, flat.drop("i").schema)


def _placed(points: DataFrame, size: Size, side: int) -> DataFrame:
    """Points with the tile that they fall into, clamped to the grid, the number of their low corner in it (_i) and the parts beyond that (_f0.._f2)."""
    width = [min(side + 1, n) for n in size]
    at = [F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(float(n - 1))) for p, n in zip(PLACE, size, strict=True)]
    rows = points.withColumns({f"_l{k}": F.least(F.floor(a), F.lit(max(n - 2, 0))).cast("int") for k, (a, n) in enumerate(zip(at, size, strict=True))})
    low = [F.col(f"_l{k}") for k in range(3)]
    i = [b % side for b in low]
    found = {"tile": Tiling(size, side).number([F.floor(b / side).cast("int") for b in low]).cast("int"), "_i": (i[0] + width[0] * (i[1] + width[1] * i[2])).cast("int")}
    return rows.withColumns(found | {f"_f{k}": a - b for k, (a, b) in enumerate(zip(at, low, strict=True))}).drop("_l0", "_l1", "_l2")


def _value(name: str, size: Size, side: int) -> Column:
    """The trilinear value of an array of a tile at a placed point; voxels that aren't there count as 0, and if none is, the value is null."""
    width, f = [min(side + 1, n) for n in size], [F.col(f"_f{k}") for k in range(3)]
    terms = []
    for bits in product((0, 1), repeat=3):
        step = sum(d * min(1, n - 1) * w for d, n, w in zip(bits, size, (1, width[0], width[0] * width[1]), strict=True))
        terms.append(F.get(name, F.col("_i") + step) * reduce(mul, [c if d else 1 - c for c, d in zip(f, bits, strict=True)]))
    # A null term makes the compiled sum null; only then the terms are added one by one, without the null ones.
    return F.coalesce(reduce(lambda a, b: a + b, terms), F.aggregate(F.array(*terms), F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, s, x)))


def points_through(points: DataFrame, fields: DataFrame | None, steps: Sequence[Step], size: Size) -> DataFrame:
    """(image_id, point_id, px, py, pz): points of images through a chain; fields are voxels (image_id, x, y, z, components).

    Points stay one row each: fields become cubes of voxels with a border, of the
    images that have points only, and a look-up is a join with the cube that a point
    falls into. Cubes are sent to all tasks up to BROADCAST bytes, counted first;
    beyond it points are dealt by image, cube and, for images with many points, by
    part. point_id should be unique within an image: points that share one all move by
    the sum of their displacements, so points are dealt by it once, and stay so where
    cubes are sent.
    """
    alike = W.partitionBy("image_id", "point_id")
    p = points.select("image_id", "point_id", *[F.col(c).cast("double").alias(c) for c in PLACE])
    names = list(dict.fromkeys(n for s in steps if isinstance(s, Field) for n in s.names))
    if names and fields is None:
        raise ValueError("a chain with a field step needs a table of fields")
    few = True
    if names:
        asked = cut(p.groupBy("image_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
        images = asked.select("image_id")
        images = F.broadcast(images) if asked.count() * 64 <= BROADCAST else images
        held = cut(_held(fields.join(images, "image_id", "left_semi"), names, size, SIDE))
        cube = 8 * len(names) * math.prod(min(SIDE + 1, n) for n in size)
        few = held.count() * cube <= BROADCAST
        if not few:
            held = joined(held, asked, ["image_id"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            p = joined(p, asked, ["image_id"], "left").withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    key = ["image_id", "tile"] if few else ["image_id", "tile", "_salt"]
    rest = [c for c in p.columns if c not in PLACE]
    for step in steps:
        if isinstance(step, Affine):
            p = p.select(*rest, *[e.alias(c) for e, c in zip(step.of(*map(F.col, PLACE)), PLACE, strict=True)])
            continue
        p = p.withColumns({f"_b{k}": F.col(c) for k, c in enumerate(PLACE)})
        cubes = held.select(*key, *[F.col(n).alias(f"_{k}") for k, n in enumerate(step.names)])
        moves = [(F.lit(-1.0) if step.inverse else F.lit(1.0)) * F.when(F.col("point_id").isNotNull(), F.sum(f"_u{k}").over(alike)) for k in range(3)]
        for _ in range(step.iterations if step.inverse else 1):
            at = _placed(p, size, SIDE)
            both = at.join(F.broadcast(cubes), key, "left") if few else joined(at, cubes, key, "left")
            looked = both.select(*rest, *[f"_b{k}" for k in range(3)], *[_value(f"_{k}", size, SIDE).alias(f"_u{k}") for k in range(3)])
            p = looked.select(*rest, *[f"_b{k}" for k in range(3)], *[(F.col(f"_b{k}") + m).alias(c) for k, (m, c) in enumerate(zip(moves, PLACE, strict=True))])
        p = p.drop("_b0", "_b1", "_b2")
    return p.select("image_id", "point_id", *PLACE)


def of_path(names: Sequence[tuple[str, str, str]], inverse: bool = False, iterations: int = 10) -> list[Step]:
    """The chain of a path of velocities, one field a time step of length 1: h <- h + v(h), or its way back."""
    steps: list[Step] = [Field(tuple(n), False, iterations) for n in names]
    return inverted(steps) if inverse else steps

