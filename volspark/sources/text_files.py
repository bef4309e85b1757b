"""Text formats: meshes, affine transforms, slice indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_byu(text: str) -> tuple[list[tuple[float, ...]], list[list[int]]]:
    """Vertices and facets; facets count from 1 and end with a negative index."""
    words = iter(text.split())
    parts, n_vertices, n_facets, _ = (int(next(words)) for _ in range(4))
    if parts != 1:
        raise ValueError("a mesh of one part is read")
    next(words), next(words)
    points = [tuple(float(next(words)) for _ in range(3)) for _ in range(n_vertices)]
    facets = []
    for _ in range(n_facets):
        facet: list[int] = []
        while not facet or facet[-1] >= 0:
            facet.append(int(next(words)))
        facets.append([abs(i) - 1 for i in facet])
    return points, facets


def format_byu(points, facets) -> str:
    lines = [f"1 {len(points)} {len(facets)} {sum(map(len, facets))}", f"1 {len(facets)}"]
    lines += [" ".join(f"{c:g}" for c in p) for p in points]
    lines += [" ".join(str(i + 1) for i in f[:-1]) + f" -{f[-1] + 1}" for f in facets]
    return "\n".join(lines) + "\n"


def parse_off(text: str) -> tuple[list[tuple[float, ...]], list[list[int]]]:
    """Vertices and facets; what follows the indices of a facet on its line is skipped."""
    lines = [x for x in (y.split("#")[0].split() for y in text.splitlines()) if x]
    head = lines.pop(0)
    counts = head[1:] if len(head) > 1 else lines.pop(0)
    n = int(counts[0])
    points = [tuple(map(float, x[:3])) for x in lines[:n]]
    return points, [[int(i) for i in x[1 : 1 + int(x[0])]] for x in lines[n : n + int(counts[1])]]


def parse_affine(text: str) -> tuple[list[float], list[float]]:
    """(row-major matrix, shift) of a text whose first line is ``matrix`` and whose rows are columns of the transform."""
    lines = text.splitlines()
    if not lines[0].startswith("matrix"):
        raise ValueError("not a matrix file")
    rows = [[float(x) for x in line.split()] for line in lines[1:5]]
    return [rows[j][i] for i in range(3) for j in range(3)], rows[3][:3]


def format_affine(matrix, shift) -> str:
    rows = [" ".join(f"{matrix[3 * i + j]:g}" for i in range(3)) + " 0" for j in range(3)]
    return "\n".join(["matrix", *rows, " ".join(f"{s:g}" for s in shift) + " 1"]) + "\n"


_MESH = "surface_id string, points array<array<double>>, facets array<array<int>>"


def _meshes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [parse_off(t) if n.endswith(".off") else parse_byu(t) for n, t in zip(batch["surface_id"], batch["value"], strict=True)]
        yield pd.DataFrame({"surface_id": batch["surface_id"], "points": [[list(p) for p in m[0]] for m in found], "facets": [m[1] for m in found]})


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, facets) of all .byu and .off files under a path; surface_id is the path."""
    files = spark.read.text(path, wholetext=True).withColumn("surface_id", F.input_file_name())
    rows = files.select("surface_id", "value").mapInPandas(_meshes, _MESH)
    vertices = rows.select("surface_id", F.posexplode("points").alias("vid", "p")).select("surface_id", "vid", *[F.col("p")[i].alias(a) for i, a in enumerate("xyz")])
    return vertices, rows.select("surface_id", F.posexplode("facets").alias("fid", "vids"))


def read_slice_index(spark: SparkSession, path: str) -> DataFrame:
    """(slice_id, z, amplitude, phase): the first and the last three fields of each line."""
    parts = F.split("value", ",")
    last = lambda k: F.element_at(parts, -k).cast("double")
    return spark.read.text(path).select(parts[0].alias("slice_id"), last(3).alias("z"), last(2).alias("amplitude"), last(1).alias("phase"))
