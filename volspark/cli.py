"""Commands over folders of volume files: ``python -m volspark.cli COMMAND IN OUT ...``.

Every command reads all volumes under a folder (or the store address of one),
which must be congruent, and writes a file for each result. Images are numbered
in the order of their paths.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.config import FULL, AtlasParams, GreedyParams, LDMMParams, Level, PreprocessParams
from volspark.operators import fields, interp, pointwise, preprocess, registration, select, spectral
from volspark.operators.aggregate import weighted_mean
from volspark.operators.grid import Size, dense, voxels
from volspark.sources import volume_files


class Folder:
    """The volumes of a folder and their common header."""

    def __init__(self, spark: SparkSession, path: str, vectors: bool = False) -> None:
        headers = volume_files.read_headers(spark, path)
        first = headers.orderBy("path").first()
        if first is None:
            raise ValueError(f"no volumes under {path}")
        self.size: Size = tuple(first["size"])
        self.spacing, self.origin = tuple(first["spacing"]), tuple(first["origin"])
        odd = preprocess.incongruent(headers.withColumn("image_id", F.lit(0)), self.size, self.origin, self.spacing)
        if not odd.isEmpty():
            raise ValueError(f"{odd.first()['path']} is not congruent with {first['path']}")
        rows = volume_files.read_fields(spark, path) if vectors else volume_files.read_volumes(spark, path)
        # One row a file: paths are numbered, not voxels.
        ids = headers.select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("image_id"))
        self.images = rows.join(ids, "path")

    def save(self, rows: DataFrame, out: str, size: Size | None = None, spacing: Sequence[float] | None = None) -> None:
        volume_files.write_volumes(rows, out, size or self.size, spacing or self.spacing, self.origin)


def _levels(text: str) -> tuple[Level, ...]:
    """Levels from a text such as ``4:50,2:20,1``, factor and iterations."""
    parts = [p.partition(":") for p in text.split(",")] if text else []
    return tuple(Level(int(f), int(n) if n else None) for f, _, n in parts) or FULL


def info(spark, a) -> None:
    volume_files.read_headers(spark, a.folder).select("path", "type", "channels", "size", "spacing", "origin").orderBy("path").show(a.most, truncate=False)


def threshold(spark, a) -> None:
    f = Folder(spark, a.folder)
    f.save(f.images.withColumn("data", F.transform("data", lambda v: pointwise.threshold(v, a.level))), a.out)


def roi(spark, a) -> None:
    f = Folder(spark, a.folder)
    box = dense(select.extract(voxels(f.images, f.size), a.start, a.extent), tuple(a.extent))
    f.save(box, a.out, tuple(a.extent))


def downsample(spark, a) -> None:
    f = Folder(spark, a.folder)
    factors = (a.factor,) * 3
    size = tuple(max(n // a.factor, 1) for n in f.size)
    f.save(dense(select.downsample(voxels(f.images, f.size), f.size, factors), size), a.out, size, [s * a.factor for s in f.spacing])


def average(spark, a) -> None:
    f = Folder(spark, a.folder)
    rows = voxels(f.images.withColumn("w", F.lit(1.0)), f.size, "data", "w")
    n = f.images.count()
    mean = weighted_mean(rows.withColumn("w", F.col("w") / n)).withColumn("image_id", F.lit(0).cast("long"))
    f.save(dense(mean, f.size, "mean_v"), a.out)


def prepare(spark, a) -> None:
    f = Folder(spark, a.folder)
    f.save(preprocess.preprocess(f.images, f.size, PreprocessParams(tukey_width=a.taper, blur_sigma=a.sigma)), a.out)


def isotropic(spark, a) -> None:
    f = Folder(spark, a.folder)
    out, size, spacing = interp.isotropic(f.images, f.size, f.spacing, a.axes)
    f.save(out, a.out, size, spacing)


def _params(a) -> GreedyParams | LDMMParams:
    return GreedyParams(iterations=a.iterations) if a.method == "greedy" else LDMMParams(iterations=a.iterations, sigma=a.sigma)


def warp(spark, a) -> None:
    """Every image of a folder to the first one."""
    f = Folder(spark, a.folder)
    fixed = f.images.filter("image_id = 0").select(F.col("data").alias("fixed"))
    pairs = f.images.filter("image_id > 0").select(F.col("image_id").alias("pair_id"), F.col("data").alias("moving")).join(fixed)
    out = registration.register(pairs, f.size, a.method, _params(a), _levels(a.levels))
    f.save(out.withColumnRenamed("pair_id", "image_id"), a.out)


def atlas(spark, a) -> None:
    f = Folder(spark, a.folder)
    rows = f.images.select(F.lit(0).alias("cohort"), "image_id", F.lit(1.0).alias("w"), "data")
    if a.method in ("affine", "rigid", "translation"):
        mean, state = registration.affine_atlas(rows, f.size, a.method, a.iterations)
    else:
        mean, state = registration.build_atlas(rows, f.size, _params(a), AtlasParams(median=a.median, trimmed_size=a.trimmed), _levels(a.levels))
    f.save(mean.select(F.col("cohort").cast("long").alias("image_id"), F.col("mean").alias("data")), f"{a.out}/mean")
    f.save(state.select("image_id", F.col("deformed").alias("data")), f"{a.out}/deformed")


def field(spark, a) -> None:
    """Fields of displacements (channels x, y, z) to places: their inverse, their exponential, or themselves smoothed."""
    f = Folder(spark, a.folder, vectors=True)
    u = f.images.withColumnsRenamed(dict(zip(fields.H, fields.U, strict=True)))
    if a.what == "smooth":
        volume_files.write_fields(spectral.kernel(u, f.size, spacing=f.spacing, inverse=True), a.out, f.size, f.spacing, f.origin, fields.U)
        return
    out = fields.invert(u, f.size, a.iterations) if a.what == "invert" else fields.group_exponential(u, f.size, a.iterations)
    volume_files.write_fields(out, a.out, f.size, f.spacing, f.origin)


def slices(spark, a) -> None:
    f = Folder(spark, a.folder)
    volume_files.write_slices(f.images, a.out, f.size, a.axis, a.index, a.form)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="volspark", description=__doc__.split("\n")[0])
    commands = p.add_subparsers(required=True)

    def command(f, *more: tuple[str, dict], out: bool = True) -> None:
        c = commands.add_parser(f.__name__, help=(f.__doc__ or f.__name__).split("\n")[0])
        c.add_argument("folder")
        if out:
            c.add_argument("out")
        for name, options in more:
            c.add_argument(name, **options)
        c.set_defaults(run=f)

    methods = ("--method", {"default": "greedy", "choices": ["greedy", "relaxation", "shooting", "affine", "rigid", "translation"]})
    common = (methods, ("--iterations", {"type": int, "default": 50}), ("--sigma", {"type": float, "default": 5.0}), ("--levels", {"default": ""}))
    command(info, ("--most", {"type": int, "default": 1000}), out=False)
    command(threshold, ("--level", {"type": float, "required": True}))
    command(roi, ("--start", {"type": int, "nargs": 3, "required": True}), ("--extent", {"type": int, "nargs": 3, "required": True}))
    command(downsample, ("--factor", {"type": int, "default": 2}))
    command(average)
    command(prepare, ("--taper", {"type": int, "default": 5}), ("--sigma", {"type": float, "default": 0.0}))
    command(isotropic, ("--axes", {"default": "xyz", "choices": ["xyz", "z"]}))
    command(warp, *common)
    command(atlas, *common, ("--median", {"action": "store_true"}), ("--trimmed", {"type": int, "default": 0}))
    command(field, ("what", {"choices": ["invert", "exponential", "smooth"]}), ("--iterations", {"type": int, "default": 5}))
    command(slices, ("--axis", {"default": "z", "choices": ["x", "y", "z"]}), ("--index", {"type": int, "default": 0}), ("--form", {"default": "pgm", "choices": ["pgm", "raw"]}))
    return p


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.appName("volspark").getOrCreate(), a)


if __name__ == "__main__":
    main()
