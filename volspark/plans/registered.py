"""Registered queries: each a Spark plan of the operators and, where SQL can express it, the SQL.

``spec`` names the columns of a query with their kinds: i integers, d doubles
(rounded to four digits), s strings, b booleans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.config import FULL, AtlasParams, GreedyParams, LDMMParams, Level, PreprocessParams
from volspark.functions import strings
from volspark.operators import aggregate, fields, interp, metadata, order, pca, pointwise, preprocess, registration, select, shapes, spectral, stencil, surface
from volspark.operators.fields import H, U
from volspark.operators.grid import AXES, dense, unpacked, voxels
from volspark.operators.interp import PLACE
from volspark.plans import inputs as src
from volspark.plans.inputs import SIZE, table, with_ctes
from volspark.sources import catalogue
from volspark.streaming import running_mean

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    plan: Plan
    spec: str
    sql: str | None


REGISTERED: dict[str, Registered] = {}
VOXEL = "image_id:i x:i y:i z:i"
COHORT = "cohort:i x:i y:i z:i"
#: Places of an affine map used by several queries.
MATRIX, SHIFT = (0.9, 0.1, 0.0, -0.1, 0.9, 0.0, 0.0, 0.0, 1.0), (0.25, 0.5, -0.25)


def query(spec: str, sql: str | None = None):
    def register(plan: Plan) -> Plan:
        REGISTERED[plan.__name__] = Registered(plan, spec, sql)
        return plan

    return register


def rounded(c: Column) -> Column:
    """F.round(c, 4) of a double; that goes by way of a decimal's text, which costs more than most queries' own work, so only numbers near a tie, large ones and NaN do."""
    scaled = c * 1e4
    whole = F.rint(scaled)
    return F.when((F.abs(c) < 1e6) & (F.abs(scaled - whole) < 0.4999), whole / 1e4).otherwise(F.round(c, 4))


def finished(df: DataFrame, spec: str) -> DataFrame:
    cast = {"i": lambda c: c.cast("long"), "d": lambda c: rounded(c.cast("double")) + F.lit(0.0), "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
    return df.select(*[cast[k](F.col(n)).alias(n) for n, k in (x.split(":") for x in spec.split())])


def finished_sql(sql: str, spec: str) -> str:
    cast = {"i": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 4) + 0.0", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}
    columns = ", ".join(f"{cast[k].format(n)} AS {n}" for n, k in (x.split(":") for x in spec.split()))
    return f"SELECT {columns} FROM (\n{sql}\n)"


LINE = {"x": "image_id, y, z ORDER BY x", "y": "image_id, x, z ORDER BY y", "z": "image_id, x, y ORDER BY z"}


def _d(value: str, axis: str, wrap: bool = False) -> str:
    """SQL of a derivative along an axis of a 4-voxel line."""
    over = f"OVER (PARTITION BY {LINE[axis]})"
    lag, lead = f"lag({value}) {over}", f"lead({value}) {over}"
    if wrap:
        whole = f"OVER (PARTITION BY {LINE[axis]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return f"(coalesce({lead}, first({value}) {whole}) - coalesce({lag}, last({value}) {whole})) / 2"
    return f"CASE WHEN {lag} IS NULL THEN {lead} - {value} WHEN {lead} IS NULL THEN {value} - {lag} ELSE ({lead} - {lag}) / 2 END"


# Flagship: preprocessing, weighted mean, variance, median and trimmed mean of each cohort.


@query(
    COHORT + " mean_v:d var_v:d median_v:d trimmed_v:d",
    with_ctes("wvox", """win AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END AS s FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM wvox)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY cohort, x, y, z ORDER BY s, image_id) - 1 AS r, count(*) OVER (PARTITION BY cohort, x, y, z) AS n FROM win),
    tk AS (SELECT *, CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 ELSE n // 5 END AS k FROM rk)""")
    + " SELECT cohort, x, y, z, sum(w * s) AS mean_v, var_samp(s) AS var_v, max(s) FILTER (r = CASE WHEN n % 2 = 0 THEN n // 2 - 1 ELSE n // 2 END) AS median_v, avg(s) FILTER (r >= k AND r < n - k) AS trimmed_v FROM tk GROUP BY ALL",
)
def cohort_atlas(spark: SparkSession, d: str) -> DataFrame:
    rows = order.ranked(pointwise.rescale_images(src.weighted(spark, d)), ["cohort"])
    n, r, v = F.col("n"), F.col("r"), F.col("v")
    k = order.trim_width(n)
    middle = F.when(n % 2 == 0, F.floor(n / 2) - 1).otherwise(F.floor(n / 2))
    return rows.groupBy("cohort", *AXES).agg(F.sum(F.col("w") * v).alias("mean_v"), F.var_samp(v).alias("var_v"), F.max(F.when(r == middle, v)).alias("median_v"), F.avg(F.when((r >= k) & (r < n - k), v)).alias("trimmed_v"))


# Sources and pointwise maps.


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT * FROM vox")
def voxel_scan(spark, d):
    return src.vox(spark, d)


@query("image_id:i n:i checksum:d", with_ctes("vox") + " SELECT image_id, count(*) AS n, sum(v * (x + 4 * y + 16 * z + 1)) AS checksum FROM vox GROUP BY image_id")
def dense_round_trip(spark, d):
    data = dense(src.vox(spark, d, dealt=True), SIZE)
    total = F.aggregate(F.transform("data", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return data.select("image_id", F.size("data").alias("n"), total.alias("checksum"))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x, y, z, CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END AS v FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM vox)")
def intensity_window(spark, d):
    return pointwise.rescale_images(src.vox(spark, d, dealt=True))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x, y, z, CASE WHEN v < -0.1 THEN 0 WHEN v > 0.1 THEN 255 ELSE 255 * (v + 0.1) / 0.2 END AS v FROM vox")
def intensity_window_fixed(spark, d):
    return src.vox(spark, d).withColumn("v", pointwise.rescale(F.col("v"), F.lit(-0.1), F.lit(0.1), 0.0, 255.0))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x, y, z, CASE WHEN v > 0.05 THEN 1 ELSE 0 END AS v FROM vox")
def threshold(spark, d):
    return src.vox(spark, d).withColumn("v", pointwise.threshold(F.col("v"), 0.05))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x, y, z, CASE WHEN min(v) OVER (PARTITION BY image_id) < 0 THEN v + 1024 ELSE v END AS v FROM vox")
def unsigned_shift(spark, d):
    return pointwise.unsigned_shift(src.vox(spark, d, dealt=True))


@query(VOXEL + " filled:d scaled:d added:d clipped:d mixed:d kind:i", with_ctes("vox") + " SELECT image_id, x, y, z, 7.5 AS filled, v * 2.5 AS scaled, v + 0.125 AS added, abs(v) AS clipped, v * 0.75 + 0.25 AS mixed, CAST(trunc(v * 100) AS INTEGER) AS kind FROM vox")
def scalar_maps(spark, d):
    v = F.col("v")
    return src.vox(spark, d).select("image_id", *AXES, pointwise.fill(7.5).alias("filled"), pointwise.scale(v, 2.5).alias("scaled"), pointwise.add(v, 0.125).alias("added"), F.abs(v).alias("clipped"), pointwise.interpolate(v, F.lit(1.0), 0.25).alias("mixed"), (v * 100).cast("int").alias("kind"))


_T = "CASE WHEN {0} < 2 THEN 0.5 * (1 - cos(pi() * {0} / 2)) ELSE 1 END"


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x, y, z, v * " + " * ".join(_T.format(e) for a in "xyz" for e in (a, f"(3 - {a})")) + " AS v FROM vox")
def tukey_window(spark, d):
    return src.vox(spark, d).withColumn("v", F.col("v") * pointwise.tukey(SIZE, 2))


def _binary(name: str, symbol: str, op) -> None:
    def plan(spark, d):
        a = src.volumes(spark, d)
        b = a.select((F.col("image_id") - 1).alias("image_id"), "data")
        return voxels(pointwise.combine(a, b, op), SIZE)

    plan.__name__ = name
    query(VOXEL + " v:d", with_ctes("vox") + f" SELECT a.image_id, a.x, a.y, a.z, {symbol} AS v FROM vox a JOIN vox b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z")(plan)


_binary("pointwise_add", "a.v + b.v", lambda a, b: a + b)
_binary("pointwise_sub", "a.v - b.v", lambda a, b: a - b)
_binary("pointwise_mul", "a.v * b.v", lambda a, b: a * b)
_binary("pointwise_div", "CASE WHEN abs(b.v) < 0.01 THEN 0 ELSE a.v / b.v END", lambda a, b: F.when(F.abs(b) < 0.01, F.lit(0.0)).otherwise(a / b))
_binary("pointwise_sqr_diff", "(a.v - b.v) * (a.v - b.v)", lambda a, b: (a - b) * (a - b))


# Regions.


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x - 1 AS x, y, z - 2 AS z, v FROM vox WHERE x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 AND z BETWEEN 2 AND 3")
def roi_extract(spark, d):
    return select.extract(src.vox(spark, d), (1, 0, 2), (2, 3, 2))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x, y, z, CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 2 AND z BETWEEN 0 AND 1 THEN 9 ELSE v END AS v FROM vox")
def roi_fill(spark, d):
    return select.fill_box(src.vox(spark, d), (1, 1, 0), (2, 2, 2), 9.0)


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT t.image_id, t.x, t.y, t.z, coalesce(s.v, t.v) AS v FROM vox t LEFT JOIN (SELECT image_id - 1 AS image_id, x + 2 AS x, y + 1 AS y, z, v FROM vox WHERE x < 2 AND y < 2 AND z < 2) s ON s.image_id = t.image_id AND s.x = t.x AND s.y = t.y AND s.z = t.z")
def roi_copy(spark, d):
    v = src.vox(spark, d)
    return select.copy_box(v.withColumn("image_id", F.col("image_id") - 1), v, (0, 0, 0), (2, 2, 2), (2, 1, 0))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT t.image_id, t.x, t.y, t.z, coalesce(s.v, 10 * t.v) AS v FROM vox t LEFT JOIN (SELECT image_id, x + 1 AS x, y, z + 1 AS z, round(10 * v) AS v FROM vox WHERE x < 3 AND z < 3) s ON s.image_id = t.image_id AND s.x = t.x AND s.y = t.y AND s.z = t.z")
def roi_copy_round(spark, d):
    v = src.vox(spark, d).withColumn("v", 10 * F.col("v"))
    return select.copy_box(v, v, (0, 0, 0), (3, 4, 3), (1, 0, 1), "round")


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x - 1 AS x, y, z - 2 AS z, v FROM vox WHERE x >= 1 AND y <= 2 AND z BETWEEN 2 AND 3")
def roi_world(spark, d):
    start, size = select.world_box((11.5, 0.0, -4.0), (99.0, 5.0, 10.0), (10.0, 1.0, -7.0), (2.0, 2.0, 2.0), SIZE)
    return select.extract(src.vox(spark, d), start, size)


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT a.image_id, a.x, a.y, a.z, CASE WHEN b.v BETWEEN 0 AND 0.1 THEN b.v ELSE a.v END AS v FROM vox a JOIN vox b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z")
def mask_select(spark, d):
    a = src.volumes(spark, d)
    return voxels(pointwise.combine(a, a.select((F.col("image_id") - 1).alias("image_id"), "data"), lambda p, q: select.masked(q, p, q, 0.0, 0.1)), SIZE)


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, x // 2 AS x, y // 2 AS y, z // 3 AS z, v FROM vox WHERE x % 2 = 0 AND y % 2 = 0 AND z % 3 = 0 AND z // 3 < 1")
def downsample_by_int(spark, d):
    return select.downsample(src.vox(spark, d), SIZE, (2, 2, 3))


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, 3 - x AS x, y, 3 - z AS z, v FROM vox")
def flip_xz(spark, d):
    return select.flip(src.vox(spark, d), SIZE, "xz")


@query(VOXEL + " v:d", with_ctes("vox") + " SELECT image_id, z AS x, x AS y, 3 - y AS z, v FROM vox")
def orientation(spark, d):
    return select.orient(src.vox(spark, d), SIZE, "zxy", "z")


@query("x:i y:i", with_ctes("flat", "seed AS (SELECT x, y FROM flat ORDER BY v DESC, x, y LIMIT 1), lim AS (SELECT quantile_cont(v, 0.4) AS lo FROM flat), op AS (SELECT x, y FROM flat, lim WHERE v >= lo), fill AS (SELECT x, y FROM op SEMI JOIN seed USING (x, y) UNION SELECT o.x, o.y FROM fill f JOIN op o ON abs(o.x - f.x) + abs(o.y - f.y) = 1)") + " SELECT x, y FROM fill")
def flood_fill(spark, d):
    rows = src.flat(spark, d)
    low = rows.agg(F.percentile("v", 0.4)).first()[0]
    best = rows.agg(F.min(F.struct(-F.col("v"), "x", "y")).alias("m")).select(F.lit(0).cast("long").alias("image_id"), "m.x", "m.y", F.lit(0).alias("z"))
    return select.flood_fill(rows, best, low, float("inf"))


# Aggregations.


@query("image_id:i min_v:d max_v:d sum_v:d mean_v:d sum_sq:d max_abs:d sum_abs:d n:i", with_ctes("vox") + " SELECT image_id, min(v) AS min_v, max(v) AS max_v, sum(v) AS sum_v, avg(v) AS mean_v, sum(v * v) AS sum_sq, max(abs(v)) AS max_abs, sum(abs(v)) AS sum_abs, count(*) AS n FROM vox GROUP BY image_id")
def image_stats(spark, d):
    return aggregate.image_stats(src.vox(spark, d, dealt=True))


@query("image_id:i norm_sq:d", with_ctes("vox") + " SELECT image_id, 1.5 * sum(v * v) AS norm_sq FROM vox GROUP BY image_id")
def l2_norm(spark, d):
    return src.vox(spark, d, dealt=True).groupBy("image_id").agg(aggregate.l2_norm_sq(1.5, F.col("v")).alias("norm_sq"))


@query("image_id:i dot:d ssd:d mse:d", with_ctes("vox") + " SELECT a.image_id, sum(a.v * b.v) AS dot, sum((a.v - b.v) ** 2) AS ssd, avg((a.v - b.v) ** 2) AS mse FROM vox a JOIN vox b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY a.image_id")
def l2_dot_ssd(spark, d):
    a = src.volumes(spark, d)
    b = a.select((F.col("image_id") - 1).alias("image_id"), F.col("data").alias("other"))
    fold = lambda f: F.aggregate(F.zip_with("data", "other", f), F.lit(0.0), lambda s, x: s + x)
    square = fold(lambda p, q: (p - q) * (p - q))
    return a.join(b, "image_id").select("image_id", fold(lambda p, q: p * q).alias("dot"), square.alias("ssd"), (square / F.size("data")).alias("mse"))


@query("image_id:i cx:d cy:d cz:d", with_ctes("vox") + " SELECT image_id, sum(x * abs(v)) / sum(abs(v)) AS cx, sum(y * abs(v)) / sum(abs(v)) AS cy, sum(z * abs(v)) / sum(abs(v)) AS cz FROM vox GROUP BY image_id")
def centroid(spark, d):
    return aggregate.centroid(src.vox(spark, d, dealt=True).withColumn("v", F.abs("v")))


@query(COHORT + " mean_v:d sum_v:d var_v:d n:i", with_ctes("vox") + " SELECT cohort, x, y, z, avg(v) AS mean_v, sum(v) AS sum_v, var_samp(v) AS var_v, count(*) AS n FROM vox GROUP BY ALL")
def voxel_mean(spark, d):
    return aggregate.voxel_mean(src.vox(spark, d), ["cohort"])


@query(COHORT + " mean_v:d", with_ctes("wvox") + " SELECT cohort, x, y, z, sum(w * v) AS mean_v FROM wvox GROUP BY ALL")
def voxel_weighted_mean(spark, d):
    return aggregate.weighted_mean(src.weighted(spark, d), ["cohort"])


@query(COHORT + " mean_v:d var_v:d std_v:d", with_ctes("wvox", "m AS (SELECT cohort, x, y, z, sum(w * v) / sum(w) AS m FROM wvox GROUP BY ALL), q AS (SELECT cohort, x, y, z, any_value(m) AS mean_v, sum(w * (v - m) ** 2) / sum(w) AS var_v FROM wvox JOIN m USING (cohort, x, y, z) GROUP BY ALL)") + " SELECT *, sqrt(var_v) AS std_v FROM q")
def weighted_variance(spark, d):
    return aggregate.weighted_stats(src.weighted(spark, d), ["cohort"])


@query(COHORT + " mean_v:d", with_ctes("wvox") + " SELECT cohort, x, y, z, sum(w * (1 + abs(v)) * v) / sum(w * (1 + abs(v))) AS mean_v FROM wvox GROUP BY ALL")
def jacobian_scaled_mean(spark, d):
    return aggregate.jacobian_mean(src.weighted(spark, d).withColumn("j", 1 + F.abs("v")), ["cohort"])


@query("x:i y:i z:i mean_v:d", with_ctes("vox", "m AS (SELECT x, y, z, avg(v) AS a, count(*) AS n FROM vox GROUP BY ALL)") + " SELECT m.x, m.y, m.z, (n * a - o.v + w.v) / n AS mean_v FROM m JOIN vox o ON o.image_id = 0 AND o.x = m.x AND o.y = m.y AND o.z = m.z JOIN vox w ON w.image_id = 1 AND w.x = m.x AND w.y = m.y AND w.z = m.z")
def incremental_mean(spark, d):
    rows = src.vox(spark, d)
    mean = aggregate.voxel_mean(rows)
    pick = lambda i, n: rows.filter(F.col("image_id") == i).select(*AXES, F.col("v").alias(n))
    joined = mean.join(pick(0, "old"), list(AXES)).join(pick(1, "new"), list(AXES))
    return joined.select(*AXES, aggregate.incremental_mean(F.col("mean_v"), F.col("old"), F.col("new"), F.col("n")).alias("mean_v"))


_DIST = "m AS (SELECT cohort, x, y, z, avg(v) AS a FROM vox GROUP BY ALL), dist AS (SELECT cohort, image_id, sum((v - a) ** 2) AS dist FROM vox JOIN m USING (cohort, x, y, z) GROUP BY ALL)"


def _distances(spark, d):
    rows = src.vox(spark, d)
    return rows, aggregate.distances(rows, aggregate.voxel_mean(rows, ["cohort"]), ["cohort"])


@query(COHORT + " mean_v:d", with_ctes("vox", _DIST) + " SELECT cohort, x, y, z, sum(v / sqrt(dist)) / sum(1 / sqrt(dist)) AS mean_v FROM vox JOIN dist USING (cohort, image_id) GROUP BY ALL")
def inverse_distance_mean(spark, d):
    rows, dist = _distances(spark, d)
    return aggregate.inverse_distance_mean(rows, dist, ["cohort"])


@query("cohort:i image_id:i w:d", with_ctes("vox", _DIST) + " SELECT cohort, image_id, CASE WHEN row_number() OVER (PARTITION BY cohort ORDER BY dist, image_id) <= greatest(count(*) OVER (PARTITION BY cohort) // 2, 1) THEN 1.0 / greatest(count(*) OVER (PARTITION BY cohort) // 2, 1) ELSE 0 END AS w FROM dist")
def trimmed_atlas_weights(spark, d):
    _, dist = _distances(spark, d)
    return order.closest_weights(dist, F.greatest(F.floor(F.col("n") / 2), F.lit(1)), ["cohort"])


# Order statistics.

_RANK = "rk AS (SELECT *, row_number() OVER (PARTITION BY cohort, x, y, z ORDER BY v, image_id) - 1 AS r, count(*) OVER (PARTITION BY cohort, x, y, z) AS n FROM vox)"


@query(COHORT + " mean_v:d", with_ctes("vox", _RANK) + " SELECT cohort, x, y, z, avg(v) AS mean_v FROM (SELECT *, CASE WHEN n < 5 THEN 0 WHEN n < 10 THEN 1 ELSE n // 5 END AS k FROM rk) WHERE r >= k AND r < n - k GROUP BY cohort, x, y, z")
def voxel_trimmed_mean(spark, d):
    return order.trimmed_mean(src.vox(spark, d), ["cohort"])


@query(COHORT + " mean_v:d", with_ctes("vox", _RANK) + " SELECT cohort, x, y, z, avg(greatest(least(v, hi), lo)) AS mean_v FROM (SELECT *, max(v) FILTER (r = 2) OVER (PARTITION BY cohort, x, y, z) AS lo, max(v) FILTER (r = n - 3) OVER (PARTITION BY cohort, x, y, z) AS hi FROM rk) GROUP BY cohort, x, y, z")
def winsorized_mean(spark, d):
    return order.winsorized_mean(src.vox(spark, d), 2, ["cohort"])


@query(COHORT + " median_v:d", with_ctes("vox", _RANK) + " SELECT cohort, x, y, z, v AS median_v FROM rk WHERE r = CASE WHEN n % 2 = 0 THEN n // 2 - 1 ELSE n // 2 END")
def voxel_lower_median(spark, d):
    return order.lower_median(src.vox(spark, d), ["cohort"])


@query(COHORT + " kth_v:d", with_ctes("vox", _RANK) + " SELECT cohort, x, y, z, v AS kth_v FROM rk WHERE r = 3")
def kth_select(spark, d):
    return order.kth(src.vox(spark, d), 3, ["cohort"])


@query("image_id:i place:i v:d", with_ctes("vox") + " SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY v, x + 4 * y + 16 * z) - 1 AS place, v FROM vox")
def sorted_voxels(spark, d):
    cells = F.array_sort(F.transform("data", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return src.volumes(spark, d).select("image_id", F.posexplode(cells).alias("place", "c")).select("image_id", "place", "c.v")


# Stencils and scans.


@query(VOXEL + " gx:d gy:d gz:d", with_ctes("vox") + f" SELECT image_id, x, y, z, {_d('v', 'x')} AS gx, {_d('v', 'y')} AS gy, {_d('v', 'z')} AS gz FROM vox")
def gradient(spark, d):
    return stencil.gradient(src.vox(spark, d, dealt=True), SIZE)


@query(VOXEL + " gx:d gy:d gz:d", with_ctes("vox") + f" SELECT image_id, x, y, z, {_d('v', 'x', True)} AS gx, {_d('v', 'y', True)} AS gy, {_d('v', 'z', True)} AS gz FROM vox")
def gradient_wrap(spark, d):
    return stencil.gradient(src.vox(spark, d, dealt=True), SIZE, wrap=True)


_SIX = " + ".join(f"lag(v) OVER (PARTITION BY {LINE[a]}) + lead(v) OVER (PARTITION BY {LINE[a]})" for a in "xyz")


@query(VOXEL + " lap:d", with_ctes("vox") + f" SELECT image_id, x, y, z, CASE WHEN x IN (1, 2) AND y IN (1, 2) AND z IN (1, 2) THEN {_SIX} - 6 * v ELSE 0 END AS lap FROM vox")
def laplacian(spark, d):
    return stencil.laplacian(src.vox(spark, d, dealt=True), SIZE)


def _separable(name: str, sql: Callable[[str], str], f) -> None:
    steps, last = [], "vox"
    for a in "xyz":
        steps.append(f"s{a} AS (SELECT image_id, x, y, z, {sql(a)} AS v FROM {last})")
        last = f"s{a}"

    def plan(spark, d):
        return f(src.vox(spark, d, dealt=True))

    plan.__name__ = name
    query(VOXEL + " v:d", with_ctes("vox", ", ".join(steps)) + " SELECT * FROM sz")(plan)


_separable("min_filter3d", lambda a: f"min(v) OVER (PARTITION BY {LINE[a]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", stencil.min_filter)
_separable("max_filter3d", lambda a: f"max(v) OVER (PARTITION BY {LINE[a]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", stencil.max_filter)
_separable("diffuse3d", lambda a: f"CASE WHEN {a} IN (1, 2) THEN avg(v) OVER (PARTITION BY {LINE[a]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE v END", lambda v: stencil.diffuse(v, SIZE))
_SIDE, _MID = (repr(x) for x in stencil.gaussian_taps(1.0, 1)[:2])


def _gauss(a: str) -> str:
    lag, lead = f"lag(v) OVER (PARTITION BY {LINE[a]})", f"lead(v) OVER (PARTITION BY {LINE[a]})"
    return f"(coalesce({lag} * {_SIDE}, 0) + v * {_MID} + coalesce({lead} * {_SIDE}, 0)) / (CASE WHEN {a} > 0 THEN {_SIDE} ELSE 0 END + {_MID} + CASE WHEN {a} < 3 THEN {_SIDE} ELSE 0 END)"


_separable("gaussian_blur", _gauss, lambda v: stencil.gaussian_blur(v, SIZE, (1, 1, 1), (2, 2, 2)))


@query(VOXEL + " v:d", with_ctes("vox", "sx AS (SELECT image_id, x, y, z, " + _gauss("x") + " AS v FROM vox), sy AS (SELECT image_id, x, y, z, " + _gauss("y") + " AS v FROM sx), sz AS (SELECT image_id, x, y, z, " + _gauss("z") + " AS v FROM sy)") + " SELECT image_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, v FROM sz WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
def gaussian_downsample(spark, d):
    return select.downsample(stencil.gaussian_blur(src.vox(spark, d, dealt=True), SIZE, (1, 1, 1), (2, 2, 2)), SIZE, (2, 2, 2))


@query(VOXEL + " div:d", with_ctes("fld") + f" SELECT image_id, x, y, z, {_d('ux', 'x')} + {_d('uy', 'y')} + {_d('uz', 'z')} AS div FROM fld")
def divergence(spark, d):
    return stencil.divergence(src.fields(spark, d, dealt=True), SIZE, U)


_J = ", ".join(f"{_d('h' + c, a)} AS j{c}{a}" for c in "xyz" for a in "xyz")


@query(VOXEL + " jac:d", with_ctes("fld", f"h AS (SELECT image_id, x, y, z, x + ux AS hx, y + uy AS hy, z + uz AS hz FROM fld), j AS (SELECT image_id, x, y, z, {_J} FROM h)") + " SELECT image_id, x, y, z, jxx * (jyy * jzz - jyz * jzy) - jxy * (jyx * jzz - jyz * jzx) + jxz * (jyx * jzy - jyy * jzx) AS jac FROM j")
def jacobian_det(spark, d):
    return stencil.jacobian_det(fields.to_h(src.fields(spark, d, dealt=True)), SIZE, H)


@query(VOXEL + " hxx:d hxy:d hxz:d hyy:d hyz:d hzz:d", with_ctes("vox", f"g AS (SELECT image_id, x, y, z, {_d('v', 'x')} AS gx, {_d('v', 'y')} AS gy, {_d('v', 'z')} AS gz FROM vox)") + " SELECT image_id, x, y, z, " + ", ".join(f"{_d('g' + a, b)} AS h{a}{b}" for a in "xyz" for b in "xyz" if a <= b) + " FROM g")
def hessian(spark, d):
    return stencil.hessian(src.vox(spark, d, dealt=True), SIZE)


_SCAN = "OVER (PARTITION BY image_id ORDER BY z, y, x ROWS UNBOUNDED PRECEDING)"


@query(VOXEL + " scan_sum:d scan_before:d scan_min:d scan_max:d", with_ctes("vox") + f" SELECT image_id, x, y, z, sum(v) {_SCAN} AS scan_sum, sum(v) {_SCAN} - v AS scan_before, min(v) {_SCAN} AS scan_min, max(v) {_SCAN} AS scan_max FROM vox")
def prefix_scan(spark, d):
    return stencil.prefix_scan(src.vox(spark, d, dealt=True), ["image_id"], ["z", "y", "x"])


@query(VOXEL + " scan_sum:d scan_min:d", with_ctes("vox") + " SELECT image_id, x, y, z, sum(v) OVER o AS scan_sum, min(v) OVER o AS scan_min FROM vox WINDOW o AS (PARTITION BY image_id ORDER BY z DESC, y DESC, x DESC ROWS UNBOUNDED PRECEDING)")
def suffix_scan(spark, d):
    return stencil.prefix_scan(src.vox(spark, d, dealt=True), ["image_id"], ["z", "y", "x"], backward=True)


@query("image_id:i ordered:b first_fault:i", with_ctes("vox", "o AS (SELECT image_id, x + 4 * y + 16 * z AS i, v - lag(v) OVER (PARTITION BY image_id ORDER BY x + 4 * y + 16 * z) AS d FROM vox)") + " SELECT image_id, min(i) FILTER (d < 0) IS NULL AS ordered, coalesce(min(i) FILTER (d < 0), -1) AS first_fault FROM o GROUP BY image_id UNION ALL SELECT DISTINCT -1 - image_id, true, -1 FROM vox")
def order_check(spark, d):
    v = src.volumes(spark, d)
    ascending = v.select((-1 - F.col("image_id")).alias("image_id"), F.array_sort("data").alias("data"))
    return order.in_order(v.select("image_id", "data").unionByName(ascending))


_LAP = ", ".join("CASE WHEN x IN (1, 2) AND y IN (1, 2) AND z IN (1, 2) THEN " + _SIX.replace("(v)", f"(u{c})") + f" - 6 * u{c} ELSE 0 END AS lu{c}" for c in "xyz")


@query(VOXEL + " lux:d luy:d luz:d", with_ctes("fld") + f" SELECT image_id, x, y, z, {_LAP} FROM fld")
def field_laplacian(spark, d):
    return stencil.field_laplacian(src.fields(spark, d, dealt=True), SIZE, U)


@query(VOXEL + " seg:i seg_sum:d seg_count:i", with_ctes("vox", f"s AS (SELECT *, sum(CASE WHEN v > 0.1 THEN 1 ELSE 0 END) {_SCAN} AS seg FROM vox)") + " SELECT image_id, x, y, z, seg, sum(v) OVER (PARTITION BY image_id, seg ORDER BY z, y, x ROWS UNBOUNDED PRECEDING) AS seg_sum, count(*) OVER (PARTITION BY image_id, seg) AS seg_count FROM s")
def segmented_scan(spark, d):
    return stencil.segmented_scan(src.vox(spark, d, dealt=True), ["image_id"], ["z", "y", "x"], F.col("v") > 0.1)


# Interpolation, warps, splats.

_W = "(CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE dz WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END)"


def _gathered(places: str, at: str = "{0}") -> str:
    c = {a: at.format(f"(CAST(floor(p{a}) AS BIGINT) + d{a})") for a in "xyz"}
    return f"""pl AS ({places}), cr AS (SELECT image_id, x, y, z, {c['x']} AS cx, {c['y']} AS cy, {c['z']} AS cz, {_W} AS w FROM pl, corner)
    SELECT cr.image_id, cr.x, cr.y, cr.z, sum(w * coalesce(s.v, 0)) AS v FROM cr LEFT JOIN vox s ON s.image_id = cr.image_id AND s.x = cx AND s.y = cy AND s.z = cz GROUP BY ALL"""


_PH = "SELECT image_id, x, y, z, x + ux AS px, y + uy AS py, z + uz AS pz FROM fld"


def _warp(name: str, strategy: str, at: str = "{0}") -> None:
    def plan(spark, d):
        return voxels(interp.warp(src.placed(spark, d), SIZE, strategy=strategy), SIZE)

    plan.__name__ = name
    query(VOXEL + " v:d", with_ctes("fld corner") + ", " + _gathered(_PH, at))(plan)


_warp("warp_h", "value")
_warp("warp_clamp", "clamp", "least(greatest({0}, 0), 3)")
_warp("warp_periodic", "wrap", "(({0} % 4) + 4) % 4")


@query(VOXEL + " v:d", with_ctes("fld corner") + ", " + _gathered("SELECT image_id, x, y, z, x + ux / 2 AS px, y + uy / 1.5 AS py, z + uz AS pz FROM fld"))
def apply_u(spark, d):
    return voxels(interp.warp(src.placed(spark, d, 1.0, (2.0, 1.5, 1.0)), SIZE), SIZE)


@query(VOXEL + " v:d", with_ctes("fld corner", "g AS (WITH " + _gathered(_PH) + ")") + " SELECT g.image_id, g.x, g.y, g.z, CASE WHEN s.v > 0 THEN g.v ELSE s.v END AS v FROM g JOIN vox s USING (image_id, x, y, z)")
def warp_masked(spark, d):
    return voxels(interp.warp_masked(src.placed(spark, d).withColumn("mask", F.col("data")), SIZE), SIZE)


@query(VOXEL + " v:d", with_ctes("fld") + " SELECT f.image_id, f.x, f.y, f.z, coalesce(s.v, 0) AS v FROM fld f LEFT JOIN vox s ON s.image_id = f.image_id AND s.x = trunc(f.x + ux + 0.5) AND s.y = trunc(f.y + uy + 0.5) AND s.z = trunc(f.z + uz + 0.5)")
def warp_nearest(spark, d):
    return voxels(interp.warp(src.placed(spark, d), SIZE, method="nearest"), SIZE)


_CUBIC = ["(-t + 2 * t * t - t * t * t) / 2", "(2 - 5 * t * t + 3 * t * t * t) / 2", "(t + 4 * t * t - 3 * t * t * t) / 2", "(-t * t + t * t * t) / 2"]
_CW = {a: "CASE k{0} WHEN 0 THEN {1} WHEN 1 THEN {2} WHEN 2 THEN {3} ELSE {4} END".format(a, *[c.replace("t", f"(p{a} - floor(p{a}))") for c in _CUBIC]) for a in "xyz"}


@query(VOXEL + " v:d", with_ctes("fld", "k AS (SELECT kx, ky, kz FROM (SELECT unnest([0, 1, 2, 3]) AS kx), (SELECT unnest([0, 1, 2, 3]) AS ky), (SELECT unnest([0, 1, 2, 3]) AS kz)), pl AS (" + _PH + ")") + f" SELECT pl.image_id, pl.x, pl.y, pl.z, sum(coalesce(s.v, 0) * ({_CW['x']}) * ({_CW['y']}) * ({_CW['z']})) AS v FROM pl CROSS JOIN k LEFT JOIN vox s ON s.image_id = pl.image_id AND s.x = floor(px) + kx - 1 AND s.y = floor(py) + ky - 1 AND s.z = floor(pz) + kz - 1 GROUP BY ALL")
def warp_cubic(spark, d):
    return voxels(interp.warp(src.placed(spark, d), SIZE, method="cubic"), SIZE)


@query(VOXEL + " v:d", with_ctes("vox corner", "g AS (SELECT unnest(range(27)) AS i), im AS (SELECT DISTINCT image_id FROM vox)") + ", " + _gathered("SELECT image_id, i % 3 AS x, (i // 3) % 3 AS y, i // 9 AS z, (i % 3) * 1.5 + 0.25 AS px, ((i // 3) % 3) * 1.5 + 0.25 AS py, (i // 9) * 1.5 + 0.25 AS pz FROM g, im"))
def trilinear_resample(spark, d):
    return voxels(interp.resample(src.volumes(spark, d), SIZE, (3, 3, 3), new_spacing=(1.5, 1.5, 1.5), centred=True), (3, 3, 3))


_AF = ", ".join(f"{MATRIX[3 * i]} * x + {MATRIX[3 * i + 1]} * y + {MATRIX[3 * i + 2]} * z + {SHIFT[i]} AS p{a}" for i, a in enumerate("xyz"))


@query(VOXEL + " v:d", with_ctes("vox corner") + ", " + _gathered(f"SELECT image_id, x, y, z, {_AF} FROM vox"))
def affine_apply(spark, d):
    return voxels(interp.affine(src.volumes(spark, d), SIZE, MATRIX, SHIFT), SIZE)


@query(VOXEL + " v:d", with_ctes("vox", "u AS (SELECT *, lead(v) OVER (PARTITION BY image_id, x, y ORDER BY z) AS a FROM vox)") + " SELECT image_id, x, y, z * 3 + k AS z, v * (1 - k / 3.0::DOUBLE) + coalesce(a, v) * (k / 3.0::DOUBLE) AS v FROM u, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR z < 3")
def refine_z(spark, d):
    return interp.refine_z(src.vox(spark, d, dealt=True), SIZE, 3)


_SPLAT = "pl AS (SELECT f.image_id, f.x + ux AS px, f.y + uy AS py, f.z + uz AS pz, s.v FROM fld f JOIN vox s USING (image_id, x, y, z)), cr AS (SELECT image_id, CAST(floor(px) AS BIGINT) + dx AS x, CAST(floor(py) AS BIGINT) + dy AS y, CAST(floor(pz) AS BIGINT) + dz AS z, v, " + _W + " AS w FROM pl, corner)"


def _splat(name: str, value: str, normalize: bool, wrap: bool) -> None:
    def plan(spark, d):
        return unpacked(interp.splat(src.placed(spark, d), SIZE, normalize=normalize, wrap=wrap), SIZE, ["data"]).withColumnRenamed("data", "v")

    plan.__name__ = name
    if wrap:
        body = f"SELECT image_id, ((x % 4) + 4) % 4 AS x, ((y % 4) + 4) % 4 AS y, ((z % 4) + 4) % 4 AS z, {value} AS v FROM cr GROUP BY ALL"
    else:
        body = f"SELECT image_id, x, y, z, {value} AS v FROM cr WHERE x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3 GROUP BY ALL"
    query(VOXEL + " v:d", with_ctes("fld corner", _SPLAT) + " " + body)(plan)


_splat("splat_h", "sum(w * v)", False, False)
_splat("splat_normalized", "CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE 0 END", True, False)
_splat("splat_periodic", "sum(w * v)", False, True)


# World coordinates and preparation.


@query(VOXEL + " v:d", with_ctes("vox corner") + ", " + _gathered("SELECT image_id, x, y, z, x - 0.25 AS px, y - 0.5 AS py, z + 0.75 AS pz FROM vox"))
def translate_image(spark, d):
    return voxels(interp.translate(src.volumes(spark, d), SIZE, (0.5, 0.5, -0.75), (2.0, 1.0, 1.0)), SIZE)


@query(VOXEL + " v:d", with_ctes("vox corner", "g AS (SELECT unnest(range(112)) AS i), im AS (SELECT DISTINCT image_id FROM vox)") + ", " + _gathered("SELECT image_id, i % 4 AS x, (i // 4) % 4 AS y, i // 16 AS z, i % 4 AS px, (i // 4) % 4 AS py, (i // 16) / 2.0::DOUBLE AS pz FROM g, im"))
def isotropic_slices(spark, d):
    out, size, _ = interp.isotropic(src.volumes(spark, d), SIZE, (1.0, 1.0, 2.0), "z")
    return voxels(out, size)


_WORLD = "SELECT image_id, 0 AS x, 0 AS y, 0 AS z, ((image_id % 7) / 2.0::DOUBLE - 1.0) / 2.0 AS px, (image_id % 5) * 0.75::DOUBLE - 0.5 AS py, (image_id % 3) + 0.25::DOUBLE AS pz FROM (SELECT DISTINCT image_id FROM vox)"


@query("image_id:i v:d", with_ctes("vox corner", "pq AS (WITH " + _gathered(_WORLD) + ")") + " SELECT image_id, v FROM pq")
def world_point_values(spark, d):
    volumes = src.volumes(spark, d)
    i = F.col("image_id")
    points = volumes.select("image_id", ((i % 7) / 2).alias("x"), ((i % 5) * 0.75).alias("y"), (i % 3 + 1.25).alias("z"))
    return interp.at_points(volumes, points, SIZE, (2.0, 1.0, 1.0), (1.0, 0.5, 1.0))


_PREPARED = ["win AS (SELECT image_id, x, y, z, CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END * " + " * ".join(_T.format(e) for a in "xyz" for e in (a, f"(3 - {a})")) + " AS v FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM vox))"]
_PREPARED += [f"{new} AS (SELECT image_id, x, y, z, {_gauss(a)} AS v FROM {old})" for a, old, new in (("x", "win", "bx"), ("y", "bx", "by_"), ("z", "by_", "bz"))]


@query(VOXEL + " v:d", with_ctes("vox", ", ".join(_PREPARED)) + " SELECT * FROM bz")
def preprocess_images(spark, d):
    return voxels(preprocess.preprocess(src.volumes(spark, d), SIZE, PreprocessParams(tukey_width=2, blur_sigma=1.0)), SIZE)


@query("c_custkey:i w:d", "SELECT c_custkey, abs(c_acctbal) / (SELECT sum(abs(c_acctbal)) FROM customer) AS w FROM customer WHERE c_custkey BETWEEN 10 AND 59")
def image_set(spark, d):
    images = table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("w"))
    return catalogue.part(images, 10, 50, weight="w", ordinal="c_custkey")


@query("x:i y:i z:i eye:d line:d dx:d", "WITH g AS (SELECT i % 8 AS x, (i // 8) % 8 AS y, i // 64 AS z FROM (SELECT unnest(range(512)) AS i)), r AS (SELECT *, sqrt((x - 4) ** 2 + (y - 4) ** 2 + (z - 4) ** 2) AS r FROM g) SELECT x, y, z, CASE WHEN r / 4 < 0.2 THEN 1 WHEN r / 4 < 0.6 THEN 0.5 WHEN r / 4 < 0.8 THEN 1 ELSE 0 END AS eye, CASE WHEN x % 4 = 0 OR y % 4 = 0 OR z % 4 = 0 THEN 1 ELSE 0 END AS line, CASE WHEN r > 0 THEN (x - 4) * 1.5 / sqrt(48.0) ELSE 0 END AS dx FROM r")
def toy_images(spark, d):
    size = (8, 8, 8)
    return shapes.grid(spark, size).withColumns({"eye": shapes.bullseye(size, (0.8, 0.6, 0.2)), "line": shapes.lines(4), "dx": shapes.dilation(size, 1.5)[0]})


@query("id:i hit:d", "SELECT p_partkey AS id, CASE WHEN p_size / 60.0::DOUBLE + (p_partkey % 13) / 26.0::DOUBLE <= 1 THEN 2.0 END AS hit FROM part")
def ray_hits(spark, d):
    at = [(F.col("p_size") / 60).alias("x"), ((F.col("p_partkey") % 13) / 26).alias("y")]
    v = lambda *c: [F.lit(float(x)) for x in c]
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), *at)
    return rows.withColumn("hit", shapes.ray_hit([F.col("x"), F.col("y"), F.lit(-4.0)], v(0, 0, 2), [v(0, 0, 0), v(1, 0, 0), v(0, 1, 0)]))


# Field algebra.


@query("image_id:i is_h:b", with_ctes("fld") + " SELECT image_id, sum((ux - x) ** 2 + (uy - y) ** 2 + (uz - z) ** 2) < sum(ux ** 2 + uy ** 2 + uz ** 2) AS is_h FROM fld GROUP BY image_id UNION ALL SELECT -1 - image_id, sum(ux ** 2 + uy ** 2 + uz ** 2) < sum((x + ux) ** 2 + (y + uy) ** 2 + (z + uz) ** 2) FROM fld GROUP BY image_id")
def is_h_field(spark, d):
    u = src.fields(spark, d, dealt=True)
    h = fields.to_h(u).select((-1 - F.col("image_id")).alias("image_id"), *AXES, *[F.col(a).alias(b) for a, b in zip(H, U, strict=True)])
    return fields.is_h_field(u).unionByName(fields.is_h_field(h))


@query(VOXEL + " hx:d hy:d hz:d back_x:d norm:d", with_ctes("fld") + " SELECT image_id, x, y, z, x + ux * 0.5 / 2 AS hx, y + uy * 0.5 / 2 AS hy, z + uz * 0.5 / 2 AS hz, (x + ux - x) * 2 AS back_x, sqrt(ux * ux + uy * uy + uz * uz) AS norm FROM fld")
def field_conversions(spark, d):
    rows = src.fields(spark, d)
    h = dict(zip(H, pointwise.velocity_to_h(U, 0.5, (2, 2, 2)), strict=True))
    back = pointwise.h_to_velocity(("kx", "ky", "kz"), (2, 2, 2))[0]
    full = rows.withColumns(dict(zip(("kx", "ky", "kz"), pointwise.velocity_to_h(U), strict=True)))
    return full.withColumn("back_x", back).withColumns(h).withColumn("norm", pointwise.norm(U))


@query("image_id:i min_n:d max_n:d sum_x:d", with_ctes("fld") + " SELECT image_id, min(sqrt(ux * ux + uy * uy + uz * uz)) AS min_n, max(sqrt(ux * ux + uy * uy + uz * uz)) AS max_n, sum(ux) AS sum_x FROM fld GROUP BY image_id")
def field_norms(spark, d):
    return src.fields(spark, d, dealt=True).withColumn("n", pointwise.norm(U)).groupBy("image_id").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.sum("ux").alias("sum_x"))


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld") + " SELECT image_id, x, y, z, x - ux AS hx, y - uy AS hy, z - uz AS hz FROM fld")
def zeroth_order_inverse(spark, d):
    h = fields.to_h(src.fields(spark, d))
    return h.select("image_id", *AXES, *[c.alias(n) for c, n in zip(pointwise.zeroth_order_inverse(), H, strict=True)])


def _with_h(spark, d) -> DataFrame:
    """(image_id, ux, uy, uz, hx, hy, hz) arrays."""
    return fields.with_places(src.dense_fields(spark, d), SIZE).withColumnsRenamed(dict(zip(PLACE, H, strict=True)))


def _shrunk(spark, d) -> DataFrame:
    """Displacements of at most 0.27 voxels, which can be inverted."""
    return src.dense_fields(spark, d).withColumns({c: F.transform(c, lambda u: u * 0.3) for c in U})


_BACK = pointwise.inverse_affine(MATRIX, SHIFT)
_BACK_SQL = ", ".join(f"{_BACK[0][3 * i]!r}::DOUBLE * x + {_BACK[0][3 * i + 1]!r}::DOUBLE * y + {_BACK[0][3 * i + 2]!r}::DOUBLE * z + {_BACK[1][i]!r}::DOUBLE AS g{a}" for i, a in enumerate("xyz"))


@query(VOXEL + " hx:d hy:d hz:d gx:d gy:d gz:d", with_ctes("vox") + " SELECT image_id, x, y, z, " + _AF.replace(" AS p", " AS h") + f", {_BACK_SQL} FROM vox")
def field_of_affine(spark, d):
    rows = src.volumes(spark, d).select("image_id")
    back = fields.of_affine(rows, SIZE, MATRIX, SHIFT, inverse=True).withColumnsRenamed(dict(zip(H, fields.G, strict=True)))
    return unpacked(fields.of_affine(back, SIZE, MATRIX, SHIFT), SIZE, [*H, *fields.G])


@query("image_id:i dot:d", with_ctes("fld") + " SELECT a.image_id, sum(a.ux * b.ux + a.uy * b.uy + a.uz * b.uz) AS dot FROM fld a JOIN fld b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY a.image_id")
def field_dot(spark, d):
    u = src.dense_fields(spark, d)
    return fields.dots(u, u.withColumn("image_id", F.col("image_id") - 1))


_FGATHER = ", ".join(f"sum(w * coalesce(f.u{a}, 0)) AS u{a}" for a in "xyz")
_FC = f"pl AS ({_PH}), cr AS (SELECT image_id, x, y, z, px, py, pz, CAST(floor(px) AS BIGINT) + dx AS cx, CAST(floor(py) AS BIGINT) + dy AS cy, CAST(floor(pz) AS BIGINT) + dz AS cz, {_W} AS w FROM pl, corner)"


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", _FC + f", g AS (SELECT cr.image_id, cr.x, cr.y, cr.z, px, py, pz, {_FGATHER} FROM cr LEFT JOIN fld f ON f.image_id = cr.image_id AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL)") + " SELECT image_id, x, y, z, px + 0.5 * ux AS hx, py + 0.5 * uy AS hy, pz + 0.5 * uz AS hz FROM g")
def compose_vh(spark, d):
    return unpacked(fields.compose_vh(_with_h(spark, d), SIZE, 0.5), SIZE, H)


def _step_h(old: str, new: str, value: str, at: str, missing: str, of: str) -> str:
    """SQL of one gather of a field at the places of ``old``: new places from the sums s{a} of weighted corners."""
    c = {a: at.format(f"(CAST(floor(o.h{a}) AS BIGINT) + d{a})") for a in "xyz"}
    w = " * ".join(f"CASE d{a} WHEN 1 THEN o.h{a} - floor(o.h{a}) ELSE 1 - (o.h{a} - floor(o.h{a})) END" for a in "xyz")
    corners = f"SELECT o.image_id, o.x, o.y, o.z, {', '.join(f'{c[a]} AS c{a}' for a in 'xyz')}, {w} AS w FROM {old} o, corner"
    sums = ", ".join(f"sum(w * {missing.format(a)}) AS s{a}" for a in "xyz")
    return f"{new} AS MATERIALIZED (SELECT image_id, x, y, z, {', '.join(value.format(a) + f' AS h{a}' for a in 'xyz')} FROM (SELECT k.image_id, k.x, k.y, k.z, {sums} FROM ({corners}) k LEFT JOIN {of} f ON f.image_id = k.image_id AND (f.x, f.y, f.z) = (k.cx, k.cy, k.cz) GROUP BY ALL))"


_EXP = ["h0 AS MATERIALIZED (SELECT image_id, x, y, z, " + ", ".join(f"{a} + u{a} / 8 AS h{a}" for a in "xyz") + " FROM fld)", *[_step_h(f"h{i}", f"h{i + 1}", "s{0}", "{0}", "coalesce(f.h{0}, c{0})", f"h{i}") for i in range(3)]]
_INV = ["sf AS (SELECT image_id, x, y, z, 0.3 * ux AS ux, 0.3 * uy AS uy, 0.3 * uz AS uz FROM fld)", "h0 AS (SELECT image_id, x, y, z, " + ", ".join(f"CAST({a} AS DOUBLE) AS h{a}" for a in "xyz") + " FROM fld)", *[_step_h(f"h{i}", f"h{i + 1}", "{0} - s{0}", "least(greatest({0}, 0), 3)", "f.u{0}", "sf") for i in range(4)]]


_HGATHER = ", ".join(f"sum(w * coalesce(f.{a} + f.u{a}, c{a})) AS h{a}" for a in "xyz")


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", _FC) + f" SELECT cr.image_id, cr.x, cr.y, cr.z, {_HGATHER} FROM cr LEFT JOIN fld f ON f.image_id = cr.image_id AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL")
def compose_fields(spark, d):
    return unpacked(fields.compose(_with_h(spark, d), SIZE, H, H), SIZE, H)


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", _FC.replace(_PH, "SELECT image_id, x, y, z, x - ux AS px, y - uy AS py, z - uz AS pz FROM fld")) + f" SELECT cr.image_id, cr.x, cr.y, cr.z, {_HGATHER} FROM cr LEFT JOIN fld f ON f.image_id = cr.image_id AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL")
def compose_hv_inverse(spark, d):
    return unpacked(fields.compose_hv(_with_h(spark, d), SIZE, -1.0), SIZE, H)


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", _FC.replace(_PH, "SELECT image_id, x, y, z, x + 0.5 AS px, y AS py, z - 0.25 AS pz FROM fld")) + f", g AS (SELECT cr.image_id, cr.x, cr.y, cr.z, {_HGATHER} FROM cr LEFT JOIN fld f ON f.image_id = cr.image_id AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL) SELECT image_id, x, y, z, hx + 1 AS hx, hy - 2 AS hy, hz AS hz FROM g")
def compose_translation(spark, d):
    return unpacked(fields.translated(_with_h(spark, d), SIZE, (0.5, 0, -0.25), (1, -2, 0)), SIZE, H)


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", ", ".join([*_INV[:4], _step_h("h2", "out_h", "s{0}", "{0}", "coalesce(f.{0} + f.u{0}, c{0})", "sf")])) + " SELECT * FROM out_h")
def compose_hv_inverse_iterative(spark, d):
    rows = fields.with_places(_shrunk(spark, d), SIZE).withColumnsRenamed(dict(zip(PLACE, H, strict=True)))
    return unpacked(fields.compose_hv_inverse_iterative(rows, SIZE, 2), SIZE, H)


@query("image_id:i min_e:d max_e:d mean_e:d std_e:d", with_ctes("fld corner", _FC + f", g AS (SELECT cr.image_id, cr.x, cr.y, cr.z, {', '.join(f'sum(w * coalesce(f.{a} - f.u{a}, c{a})) AS h{a}' for a in 'xyz')} FROM cr LEFT JOIN fld f ON f.image_id = cr.image_id AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL), e AS (SELECT image_id, sqrt((hx - x) ** 2 + (hy - y) ** 2 + (hz - z) ** 2) AS e FROM g WHERE x IN (1, 2) AND y IN (1, 2) AND z IN (1, 2))") + " SELECT image_id, min(e) AS min_e, max(e) AS max_e, avg(e) AS mean_e, stddev_samp(e) AS std_e FROM e GROUP BY image_id")
def inverse_consistency(spark, d):
    inverse = fields.with_places(src.dense_fields(spark, d), SIZE, -1.0).select("image_id", *[F.col(p).alias(g) for p, g in zip(PLACE, fields.G, strict=True)])
    return fields.inverse_consistency(_with_h(spark, d).join(inverse, "image_id"), SIZE, 1)


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", ", ".join(_EXP)) + " SELECT * FROM h3")
def group_exponential(spark, d):
    return unpacked(fields.group_exponential(src.dense_fields(spark, d), SIZE, 3), SIZE, H)


@query(VOXEL + " hx:d hy:d hz:d", with_ctes("fld corner", ", ".join(_INV)) + " SELECT * FROM h4")
def iterative_inverse(spark, d):
    return unpacked(fields.invert(_shrunk(spark, d), SIZE, 4), SIZE, H)


# Kernels, linear algebra, registration.


_TURN = "(x * kx + y * ky + z * kz) * pi() / 2"
_FQ = f"""fq AS (SELECT i % 4 AS kx, (i // 4) % 4 AS ky, i // 16 AS kz FROM (SELECT unnest(range(64)) AS i)),
    ft AS MATERIALIZED (SELECT image_id, kx, ky, kz, {', '.join(f'sum(u{a} * cos({_TURN})) AS r{a}, -sum(u{a} * sin({_TURN})) AS i{a}' for a in 'xyz')} FROM fld, fq GROUP BY ALL)"""
#: The matrix of the operator at a frequency, with alpha = beta = 0.01 and gamma = 0.001, and its inverse by cofactors.
_LM = f"""lm AS (SELECT kx, ky, kz, {', '.join(f'2 * cos(k{a} * pi() / 2) - 2 AS c{a}, sin(k{a} * pi() / 2) AS d{a}' for a in 'xyz')} FROM fq),
    lb AS (SELECT kx, ky, kz, 0.001 - 0.01 * (cx + cy + cz) - 0.01 * cx AS a, 0.01 * dx * dy AS b, 0.01 * dx * dz AS c, 0.001 - 0.01 * (cx + cy + cz) - 0.01 * cy AS e, 0.01 * dy * dz AS f, 0.001 - 0.01 * (cx + cy + cz) - 0.01 * cz AS i FROM lm),
    li AS (SELECT kx, ky, kz, e * i - f * f AS xx, c * f - b * i AS xy, b * f - c * e AS xz, a * i - c * c AS yy, b * c - a * f AS yz, a * e - b * b AS zz, a * (e * i - f * f) - b * (b * i - c * f) + c * (b * f - c * e) AS det FROM lb)"""


def _solved(part: str) -> str:
    rows = {"x": ("xx", "xy", "xz"), "y": ("xy", "yy", "yz"), "z": ("xz", "yz", "zz")}
    return ", ".join(f"({m[0]} * {part}x + {m[1]} * {part}y + {m[2]} * {part}z) / det AS {part}{a}" for a, m in rows.items())


_KF = f"{_FQ}, {_LM}, sk AS MATERIALIZED (SELECT image_id, kx, ky, kz, {_solved('r')}, {_solved('i')} FROM ft JOIN li USING (kx, ky, kz)), vx AS (SELECT DISTINCT x, y, z FROM vox), kf AS (SELECT image_id, x, y, z, sum(rx * cos({_TURN}) - ix * sin({_TURN})) / 64 AS ux FROM sk, vx GROUP BY ALL)"


@query("image_id:i ux:d", with_ctes("fld", _KF) + " SELECT image_id, sum(abs(ux)) AS ux FROM kf GROUP BY image_id")
def diffoper_k(spark, d):
    out = spectral.kernel(src.dense_fields(spark, d), SIZE, inverse=True)
    return out.select("image_id", F.aggregate("ux", F.lit(0.0), lambda s, v: s + F.abs(v)).alias("ux"))


@query("cohort:i a:i b:i dot:d", with_ctes("vox") + " SELECT a.cohort, a.image_id AS a, b.image_id AS b, sum(a.v * b.v) AS dot FROM vox a JOIN vox b ON a.cohort = b.cohort AND a.image_id <= b.image_id AND a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY ALL")
def gram_matrix(spark, d):
    return pca.gram_matrix(src.volumes(spark, d), ["cohort"])


def _power_sql(count: int, iterations: int) -> str:
    """Power iteration on centred voxels, one step after the other, with deflation."""
    out = ["n AS (SELECT count(*) AS n FROM embeddings)", "r0 AS MATERIALIZED (SELECT image_id, x, y, z, v - avg(v) OVER (PARTITION BY x, y, z) AS v FROM vox)"]
    for k in range(count):
        out.append(f"v{k}_0 AS MATERIALIZED (SELECT DISTINCT x, y, z, ((x * 7 + y * 13 + z * 29 + {k} * 17 + 3) * 7919 % 1009) / 1009.0::DOUBLE - 0.5 AS c FROM vox)")
        for t in range(iterations):
            out.append(f"p{k}_{t} AS MATERIALIZED (SELECT image_id, sum(v * c) AS p FROM r{k} JOIN v{k}_{t} USING (x, y, z) GROUP BY image_id)")
            out.append(f"w{k}_{t} AS MATERIALIZED (SELECT x, y, z, sum(v * p) / (SELECT n FROM n) AS c FROM r{k} JOIN p{k}_{t} USING (image_id) GROUP BY x, y, z)")
            out.append(f"v{k}_{t + 1} AS MATERIALIZED (SELECT x, y, z, c / (SELECT sqrt(sum(c * c)) FROM w{k}_{t}) AS c FROM w{k}_{t})")
        out.append(f"q{k} AS MATERIALIZED (SELECT image_id, sum(v * c) AS p FROM r{k} JOIN v{k}_{iterations} USING (x, y, z) GROUP BY image_id)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT image_id, x, y, z, v - p * c AS v FROM r{k} JOIN q{k} USING (image_id) JOIN v{k}_{iterations} USING (x, y, z))")
    return with_ctes("vox", ", ".join(out)) + " " + " UNION ALL ".join(f"SELECT {k} AS k, sqrt(sum(c * c)) AS value FROM w{k}_{iterations - 1}" for k in range(count))


@query("k:i value:d", _power_sql(2, 8))
def pca_power(spark, d):
    found = pca.power_components(src.volumes(spark, d), SIZE, 2, 8)
    return spark.createDataFrame([(k, value) for k, (value, _) in enumerate(found)], "k int, value double")


@query("image_id:i i:i j:i s:d", with_ctes("vox", f"g AS (SELECT image_id, v AS residual, [{_d('v', 'x')}, {_d('v', 'y')}, {_d('v', 'z')}] AS g, [x, y, z] AS p FROM vox), t AS (SELECT image_id, residual, [g[k // 3 + 1] * p[k % 3 + 1] for k in range(9)] AS t FROM g), ij AS (SELECT i, j FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(10)) AS j) WHERE j >= i)") + " SELECT image_id, i, j, sum(t[i + 1] * CASE WHEN j = 9 THEN residual ELSE t[j + 1] END) AS s FROM t, ij GROUP BY ALL")
def affine_normal_equations(spark, d):
    return pca.normal_equations_affine(stencil.gradient(src.vox(spark, d, dealt=True), SIZE).withColumn("residual", F.col("v")))


def _pairs(spark, d):
    v = src.volumes(spark, d)
    b = v.select((F.col("image_id") - 1).alias("pair_id"), F.col("data").alias("fixed"))
    return v.select(F.col("image_id").alias("pair_id"), F.col("data").alias("moving")).join(b, "pair_id")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Few rows with much work each, dealt over all cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def _registration(name: str, method: str, params, levels=FULL) -> None:
    def plan(spark, d):
        out = registration.register(_spread(_pairs(spark, d), "pair_id"), SIZE, method, params, levels)
        return out.select("pair_id", F.element_at("energy", 1).alias("first_e"), F.element_at("energy", -1).alias("last_e"), F.size("energy").alias("n"))

    plan.__name__ = name
    query("pair_id:i first_e:d last_e:d n:i")(plan)


_registration("greedy_warp", "greedy", GreedyParams(iterations=10))
_registration("ldmm_shoot", "shooting", LDMMParams(iterations=5))
_registration("ldmm_relax", "relaxation", LDMMParams(iterations=5))
_registration("affine_register", "affine", None)
_registration("rigid_register", "rigid", None)
_registration("translation_register", "translation", None)
_registration("greedy_multiscale", "greedy", GreedyParams(iterations=5), (Level(2, 10), Level(1)))
_registration("ldmm_relax_multiscale", "relaxation", LDMMParams(iterations=3, reparameterise=2), (Level(2, 3), Level(1)))


@query("pair_id:i scale:i iter:i total:d change:d")
def energy_history(spark, d):
    out = registration.register(_spread(_pairs(spark, d), "pair_id"), SIZE, "greedy", GreedyParams(iterations=2), (Level(2), Level(1)))
    return registration.energy_events(out)


def _atlas(name: str, params, atlas: AtlasParams = AtlasParams(), levels=FULL) -> None:
    def plan(spark, d):
        images = src.volumes(spark, d).withColumn("w", F.lit(1.0))
        _, state = registration.build_atlas(images, SIZE, params, atlas, levels)
        return state.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("energy").alias("energy"))

    plan.__name__ = name
    query("cohort:i n:i energy:d")(plan)


_atlas("greedy_atlas", GreedyParams(iterations=3))
_atlas("greedy_atlas_trimmed", GreedyParams(iterations=3), AtlasParams(trimmed_size=20, median=True))
_atlas("ldmm_atlas", LDMMParams(iterations=2), levels=(Level(2, 2), Level(1)))
_atlas("ldmm_atlas_voxel_median", LDMMParams(iterations=2), AtlasParams(voxel_median=True))


@query("cohort:i n:i energy:d")
def affine_atlas(spark, d):
    images = src.volumes(spark, d).withColumn("w", F.lit(1.0))
    _, state = registration.affine_atlas(images, SIZE, "rigid", 2)
    return state.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("energy").alias("energy"))


# Surfaces and contours.

_OCT = "fc AS (SELECT unnest(range(8)) AS k), rd AS (SELECT n_nationkey AS surface_id, 1.0 + n_nationkey AS r FROM nation)"


@query("surface_id:i volume:d area:d", with_ctes("", _OCT) + " SELECT surface_id, 4.0 / 3 * r ** 3 AS volume, 4 * sqrt(3.0) * r ** 2 AS area FROM rd")
def surface_volume(spark, d):
    points, facets = surface.sphere()
    radii = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("surface_id"), (1.0 + F.col("n_nationkey")).alias("r"))
    each = lambda rows: F.posexplode(F.array(*[F.array(*map(F.lit, r)) for r in rows]))
    v = radii.select("surface_id", "r", each(points).alias("vid", "p")).select("surface_id", "vid", *[(F.col("p")[i] * F.col("r")).alias(a) for i, a in enumerate(AXES)])
    return surface.volume_and_centroid(surface.corners(radii.select("surface_id", each(facets).alias("fid", "vids")), v))


_PTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, CAST(p_partkey % 17 AS DOUBLE) AS z FROM part"
_REF = "SELECT s_suppkey % 50 AS x, abs(s_acctbal) / 500 AS y, s_suppkey % 17 AS z FROM supplier"


def _points(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 17).cast("double").alias("z"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 50).cast("double").alias("x"), (F.abs("s_acctbal") / 500).alias("y"), (F.col("s_suppkey") % 17).cast("double").alias("z"))
    return p, s


_NEAR = f"p AS ({_PTS}), q AS ({_REF}), n AS (SELECT id, min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS dist FROM p, q GROUP BY id)"


@query("id:i dist:d", with_ctes("", _NEAR) + " SELECT * FROM n")
def point_surface_distance(spark, d):
    return surface.nearest_distance(*_points(spark, d), ["id"])


@query("hausdorff:d mean_dist:d", with_ctes("", _NEAR) + " SELECT max(dist) AS hausdorff, avg(dist) AS mean_dist FROM n")
def hausdorff(spark, d):
    return surface.hausdorff(*_points(spark, d), ["id"])


_CONTOUR = "SELECT s_nationkey AS k, s_suppkey AS seq, s_suppkey % 50 AS x, abs(s_acctbal) / 500 AS y, s_suppkey % 17 AS z FROM supplier"


def _contours(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") % 50).cast("double").alias("x"), (F.abs("s_acctbal") / 500).alias("y"), (F.col("s_suppkey") % 17).cast("double").alias("z"))


@query("k:i perimeter:d points:i", with_ctes("", f"c AS ({_CONTOUR}), e AS (SELECT k, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2 + (z - lag(z) OVER o) ** 2) AS s FROM c WINDOW o AS (PARTITION BY k ORDER BY seq))") + " SELECT k, coalesce(sum(s), 0) AS perimeter, count(*) AS points FROM e GROUP BY k")
def contour_perimeter(spark, d):
    return surface.perimeter(_contours(spark, d), ["k"], "seq")


@query("k:i min_x:d max_x:d mean_x:d min_y:d max_y:d mean_y:d", with_ctes("", f"c AS ({_CONTOUR})") + " SELECT k, min(x) AS min_x, max(x) AS max_x, avg(x) AS mean_x, min(y) AS min_y, max(y) AS max_y, avg(y) AS mean_y FROM c GROUP BY k")
def contour_extent(spark, d):
    return surface.extent(_contours(spark, d), "k")


# Metadata and text.


@query("bin:i event_id:i value:d away:d n:i", "SELECT user_id % 20 AS bin, first(event_id ORDER BY abs(value - 25.0), event_id) AS event_id, first(value ORDER BY abs(value - 25.0), event_id) AS value, min(abs(value - 25.0)) AS away, count(*) AS n FROM events GROUP BY 1")
def bin_slices(spark, d):
    return metadata.bin_slices(table(spark, d, "events"), F.col("user_id") % 20, "value", 25.0, "event_id")


@query("start:i event_type:s n:i mean_v:d", "SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) * 600 AS start, event_type, count(*) AS n, avg(value) AS mean_v FROM events GROUP BY 1, 2")
def slice_windows(spark, d):
    return running_mean.windowed_stats(table(spark, d, "events")).withColumn("start", F.unix_timestamp("start"))


@query("digest:s first_id:i copies:i", "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def catalog_dedup(spark, d):
    return metadata.first_seen(table(spark, d, "documents"), F.md5(F.encode("text", "UTF-8")), "doc_id")


@query("known_n:i unknown_n:i", "WITH s AS (SELECT md5(text) AS digest, doc_id FROM documents), k AS (SELECT digest FROM s WHERE doc_id % 2 = 0) SELECT count(*) FILTER (digest IN (SELECT digest FROM k)) AS known_n, count(*) FILTER (digest NOT IN (SELECT digest FROM k)) AS unknown_n FROM s")
def digest_lookup(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    old = files.filter("doc_id % 2 = 0").select("digest").distinct()
    return metadata.known(files, old).agg(F.count("*").alias("known_n")).join(metadata.unknown(files, old).agg(F.count("*").alias("unknown_n")))


@query("n_name:s n_regionkey:i place:i", "SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation WHERE n_regionkey <> 2")
def dictionary_sorted(spark, d):
    return metadata.dictionary(table(spark, d, "nation"), F.col("n_regionkey") != 2, [F.col("n_regionkey"), F.col("n_name")])


@query("c_custkey:i uid:s", "SELECT c_custkey, '1.2.840.' || c_nationkey || '.' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS uid FROM customer")
def assigned_uids(spark, d):
    return metadata.assign_uids(table(spark, d, "customer"), "1.2.840", "c_nationkey", "c_custkey")


@query("o_custkey:i series:i total:d last_order:s", "SELECT o_custkey, count(*) AS series, sum(o_totalprice) AS total, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_order FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
def study_series(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("series"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").cast("date").cast("string").alias("last_order"))


@query("bin:i first:i n:i", "WITH t AS (SELECT count(*) AS total FROM orders), b AS (SELECT unnest(range(7)) AS bin) SELECT bin, bin * (total // 7) + least(bin, total % 7) AS first, total // 7 + CASE WHEN bin < total % 7 THEN 1 ELSE 0 END AS n FROM t, b")
def histogram_distribute(spark, d):
    total = table(spark, d, "orders").agg(F.count("*").alias("total"))
    return total.select(F.explode(metadata.blocks(F.col("total"), 7)).alias("b")).select("b.*")


@query(
    "page_id:i upper:s lower:s trimmed:s parts:i base:s ext:s forced:s",
    r"""WITH n AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name FROM pages), e AS (SELECT *, CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') ELSE '' END AS ext FROM n)
    SELECT page_id, upper(url) AS upper, lower(url) AS lower, trim('  ' || url || ' ') AS trimmed, len([t for t in string_split_regex(url, '[/:.]') if t <> '']) AS parts,
    CASE WHEN ext = '' THEN name ELSE left(name, length(name) - length(ext) - 1) END AS base, ext, CASE WHEN ext = 'raw' THEN url ELSE url || '.raw' END AS forced FROM e""",
)
def string_functions(spark, d):
    url = F.col("url")
    name = strings.split_name(url)
    return table(spark, d, "pages").select("page_id", F.upper(url).alias("upper"), F.lower(url).alias("lower"), F.trim(F.concat(F.lit("  "), url, F.lit(" "))).alias("trimmed"), F.size(strings.tokenize(url, "/:.")).alias("parts"), name["base"].alias("base"), name["ext"].alias("ext"), strings.force_extension(url, "raw").alias("forced"))
