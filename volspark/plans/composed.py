"""Registered queries of principal images and of chains of transforms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from volspark.operators import chains, components, stencil, tiles
from volspark.operators.chains import Affine, Field
from volspark.operators.fields import H, U
from volspark.operators.interp import PLACE
from volspark.operators.tiles import Tiling
from volspark.plans import inputs as src
from volspark.plans.inputs import SIZE, with_ctes
from volspark.plans.registered import _J, MATRIX, SHIFT, VOXEL, query
from volspark.plans.state import cut
from volspark.plans.tiled import _corners

#: One tile an image; tests have several.
GRID = Tiling(SIZE, 4)

# Principal images.

COUNT, ITERATIONS, WIDTH = 2, 4, 24


def _principal_sql() -> str:
    """Two components by orthogonal iteration, one step after the other."""
    out = [
        "n AS (SELECT count(*) AS n FROM embeddings)",
        "r AS MATERIALIZED (SELECT image_id, x + 4 * y + 16 * z AS i, v - avg(v) OVER (PARTITION BY x, y, z) AS v FROM vox)",
        "v0 AS MATERIALIZED (SELECT k, i, ((i * (2 * k + 7) + 17 * k + 3) * 7919 % 1009) / 1009.0::DOUBLE - 0.5 AS c FROM (SELECT unnest(range(64)) AS i), (SELECT unnest([0, 1]) AS k))",
    ]
    for t in range(ITERATIONS):
        out += [
            f"p{t} AS MATERIALIZED (SELECT image_id, k, sum(v * c) AS p FROM r JOIN v{t} USING (i) GROUP BY ALL)",
            f"w{t} AS MATERIALIZED (SELECT k, i, sum(v * p) / (SELECT n FROM n) AS c FROM r JOIN p{t} USING (image_id) GROUP BY k, i)",
            f"b{t} AS MATERIALIZED (SELECT a.i, a.c AS a, b.c - a.c * (sum(a.c * b.c) OVER () / sum(a.c * a.c) OVER ()) AS b FROM w{t} a JOIN w{t} b ON a.i = b.i AND a.k = 0 AND b.k = 1)",
            f"s{t} AS MATERIALIZED (SELECT sqrt(sum(a * a)) AS a, sqrt(sum(b * b)) AS b FROM b{t})",
            f"v{t + 1} AS MATERIALIZED (SELECT 0 AS k, i, b{t}.a / s{t}.a AS c FROM b{t}, s{t} UNION ALL SELECT 1, i, b{t}.b / s{t}.b FROM b{t}, s{t})",
        ]
    return with_ctes("vox", ", ".join(out))


_LAST = f"v{ITERATIONS}", f"s{ITERATIONS - 1}"


def _found(spark, d):
    images = src.volumes(spark, d)
    return images, components.principal_images(images, COUNT, ITERATIONS, WIDTH)


@query("k:i i:i value:d c:d", _principal_sql() + " SELECT k, i, CASE k WHEN 0 THEN a ELSE b END AS value, c FROM {0}, {1}".format(*_LAST))
def pca_images(spark, d):
    """The voxels of the first two components, and their values, from images in pieces of 24 voxels."""
    _, found = _found(spark, d)
    values = F.array(*map(F.lit, found.values))
    return components.component_images(found).select("k", "i", values[F.col("k")].alias("value"), "c")


_SCORES = "q AS MATERIALIZED (SELECT image_id, k, sum(v * c) AS score FROM r JOIN {0} USING (i) GROUP BY ALL), e AS (SELECT image_id, sum(v * v) AS total FROM r GROUP BY image_id)".format(*_LAST)


@query("image_id:i k:i score:d error:d", _principal_sql() + ", " + _SCORES + " SELECT image_id, k, score, greatest(total - sum(score * score) OVER (PARTITION BY image_id ORDER BY k), 0) AS error FROM q JOIN e USING (image_id)")
def pca_projections(spark, d):
    images, found = _found(spark, d)
    return components.projections(images, found)


_REBUILT = "m AS (SELECT x + 4 * y + 16 * z AS i, avg(v) AS m FROM vox GROUP BY 1)"


@query("image_id:i i:i v:d", _principal_sql() + ", " + _SCORES + ", " + _REBUILT + " SELECT image_id, i, any_value(m) + sum(score * c) AS v FROM q JOIN {0} USING (k) JOIN m USING (i) GROUP BY image_id, i".format(*_LAST))
def pca_rebuilt(spark, d):
    images, found = _found(spark, d)
    rows = components.rebuilt(images, found).select("image_id", "block", F.posexplode("data").alias("j", "v"))
    return rows.select("image_id", (F.col("block") * WIDTH + F.col("j")).alias("i"), "v")


# Chains.

_SECOND = ("uz", "ux", "uy")
#: A map, a field, a shift, and another field; the way back; and for points, its first two iterations.
CHAIN = [Affine(MATRIX, SHIFT), Field(), Affine(shift=(0.5, -0.25, 0.0)), Field(_SECOND)]
INVERSE = chains.inverted(CHAIN)
BACK = [Field(s.names, True, 2) if isinstance(s, Field) else s for s in chains.inverted(CHAIN)]
PATH = chains.of_path([U, _SECOND, U])
PATH_BACK = chains.of_path([U, _SECOND], inverse=True, iterations=2)


def _chain_sql(steps, start: str, key: str = "x, y, z") -> tuple[list[str], str]:
    """Relations (image_id, key, px, py, pz) of the steps, one after the other, and the last one's name."""
    out, last = [], start
    for k, step in enumerate(steps):
        if isinstance(step, Affine):
            to = step.of(*PLACE_SQL)
            out.append(f"a{k} AS MATERIALIZED (SELECT image_id, {key}, {', '.join(f'{e} AS {p}' for e, p in zip(to, PLACE, strict=True))} FROM {last})")
            last = f"a{k}"
            continue
        base, sign = last, "-" if step.inverse else "+"
        for t in range(step.iterations if step.inverse else 1):
            c = _corners(f"c{k}_{t}", last, "least(greatest({0}, 0), 3)").replace("SELECT image_id, x, y, z,", f"SELECT image_id, {key},")
            out.append(c.replace(" AS (", " AS MATERIALIZED (", 1))
            out.append(f"u{k}_{t} AS MATERIALIZED (SELECT c.image_id, {', '.join('c.' + n for n in key.split(', '))}, {', '.join(f'sum(w * f.{n}) AS d{a}' for n, a in zip(step.names, 'xyz', strict=True))} FROM c{k}_{t} c JOIN fld f ON f.image_id = c.image_id AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL)")
            out.append(f"m{k}_{t} AS MATERIALIZED (SELECT b.image_id, {', '.join('b.' + n for n in key.split(', '))}, {', '.join(f'b.p{a} {sign} d{a} AS p{a}' for a in 'xyz')} FROM {base} b LEFT JOIN u{k}_{t} USING (image_id, {key}))")
            last = f"m{k}_{t}"
    return out, last


class _Sql:
    """An SQL expression with the arithmetic that Affine.of writes."""

    def __init__(self, text: str):
        self.text = text

    def __mul__(self, other: float) -> _Sql:
        return _Sql(f"{self.text} * {other!r}::DOUBLE")

    def __add__(self, other: _Sql | float) -> _Sql:
        return _Sql(f"{self.text} + " + (other.text if isinstance(other, _Sql) else f"{other!r}::DOUBLE"))

    def __str__(self) -> str:
        return self.text


PLACE_SQL = [_Sql(p) for p in PLACE]
_START = "st AS (SELECT image_id, x, y, z, x::DOUBLE AS px, y::DOUBLE AS py, z::DOUBLE AS pz FROM fld)"


def _warp_sql(steps) -> str:
    rows, last = _chain_sql(steps, "st")
    return with_ctes("fld corner", ", ".join([_START, *rows, _corners("cr", last)])) + " SELECT cr.image_id, cr.x, cr.y, cr.z, sum(w * coalesce(s.v, 0)) AS v FROM cr LEFT JOIN vox s ON s.image_id = cr.image_id AND s.x = cx AND s.y = cy AND s.z = cz GROUP BY ALL"


def _places_sql(steps) -> str:
    rows, last = _chain_sql(steps, "st")
    return with_ctes("fld corner", ", ".join([_START, *rows, f"h AS (SELECT image_id, x, y, z, px AS hx, py AS hy, pz AS hz FROM {last})"]))


def _tiles(spark, d):
    both = src.dense_fields(spark, d).join(src.volumes(spark, d).select("image_id", F.col("data").alias("v")), "image_id")
    return cut(tiles.of_images(both, GRID, ("v", *U)))


@query(VOXEL + " v:d", _warp_sql(CHAIN))
def transform_chain(spark, d):
    """Images through a map, a field, a shift and a field, sampled once."""
    t = _tiles(spark, d)
    return tiles.untiled(chains.apply(t, t, CHAIN, GRID), GRID)


@query(VOXEL + " v:d", _warp_sql(INVERSE))
def transform_chain_back(spark, d):
    """Images through the inverse of the chain, fields with all iterations of ``Field``."""
    t = _tiles(spark, d)
    return tiles.untiled(chains.apply(t, t, INVERSE, GRID), GRID)


def _path(spark, d, steps):
    t = _tiles(spark, d)
    h = tiles.untiled(chains.places(t, t, steps, GRID), GRID, PLACE)
    return h.withColumnsRenamed(dict(zip(PLACE, H, strict=True)))


@query(VOXEL + " hx:d hy:d hz:d", _places_sql(PATH_BACK) + " SELECT * FROM h")
def velocity_path_back(spark, d):
    return _path(spark, d, PATH_BACK)


@query(VOXEL + " jac:d", _places_sql(PATH) + f", j AS (SELECT image_id, x, y, z, {_J} FROM h) SELECT image_id, x, y, z, jxx * (jyy * jzz - jyz * jzy) - jxy * (jyx * jzz - jyz * jzx) + jxz * (jyx * jzy - jyy * jzx) AS jac FROM j")
def velocity_path_jacobian(spark, d):
    """Determinants of the derivative of a path of three velocities."""
    return stencil.jacobian_det(_path(spark, d, PATH), SIZE, H)


_POINTS = """st AS (SELECT (SELECT min(vec_id) FROM embeddings) + l_suppkey % 40 AS image_id, l_orderkey * 8 + l_linenumber AS point_id, (l_partkey % 37) / 8.0::DOUBLE - 0.5 AS px, l_quantity::DOUBLE / 12 AS py, (l_orderkey % 29) / 7.0::DOUBLE - 0.25 AS pz FROM lineitem)"""


def _points_sql(steps) -> str:
    rows, last = _chain_sql(steps, "st", "point_id")
    return with_ctes("fld corner", ", ".join([_POINTS, *rows])) + f" SELECT image_id, point_id, px, py, pz FROM {last}"


def _points(spark, d):
    first = src.table(spark, d, "embeddings").agg(F.min("vec_id").alias("first"))
    place = [F.col("l_partkey") % 37 / F.lit(8.0) - 0.5, F.col("l_quantity").cast("double") / 12, F.col("l_orderkey") % 29 / F.lit(7.0) - 0.25]
    rows = src.table(spark, d, "lineitem").join(F.broadcast(first))
    return rows.select((F.col("first") + F.col("l_suppkey") % 40).alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), *[e.alias(p) for e, p in zip(place, PLACE, strict=True)])


@query("image_id:i point_id:i px:d py:d pz:d", _points_sql(CHAIN))
def points_through_chain(spark, d):
    """A point for every line item, dealt over 40 images, through a chain."""
    return chains.points_through(_points(spark, d), src.fields(spark, d), CHAIN, SIZE)


@query("image_id:i point_id:i px:d py:d pz:d", _points_sql(BACK))
def points_through_chain_back(spark, d):
    return chains.points_through(_points(spark, d), src.fields(spark, d), BACK, SIZE)
