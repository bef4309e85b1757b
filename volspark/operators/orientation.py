"""Consistent orientation of meshes: components of facets with the parity of their flips.

Facets that share an edge agree if they run along it in opposite directions.
Components are found by hooking and pointer jumping: each root hooks onto its
least neighbouring root, with the parity of the edge between them, pointers are
doubled until all point at roots, and edges between roots are all that is left
for the next round. So rounds are few, whatever the longest path, and what a
round reads shrinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.plans.state import cut, joined

FACET = ["surface_id", "fid"]


def adjacency(facets: DataFrame) -> DataFrame:
    """(surface_id, u, v, s) of facets (surface_id, fid, vids) with u < v that share an edge; s is 1 if they disagree.

    An edge with more than two facets links each of them with the least one.
    """
    n = F.size("vids")
    along = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("vids", i).alias("p"), F.get("vids", (i + 1) % n).alias("q")))
    edges = facets.filter(n >= 3).select(*FACET, F.explode(along).alias("e")).filter("e.p <> e.q")
    edges = edges.select(*FACET, F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi"), (F.col("e.p") < F.col("e.q")).alias("d"))
    first = edges.groupBy("surface_id", "lo", "hi").agg(F.min(F.struct("fid", "d")).alias("f"))
    both = joined(edges, first, ["surface_id", "lo", "hi"]).filter(F.col("fid") > F.col("f.fid"))
    return both.select("surface_id", F.col("f.fid").alias("u"), F.col("fid").alias("v"), (F.col("d") == F.col("f.d")).cast("int").alias("s")).distinct()


def _jumped(parent: DataFrame) -> DataFrame:
    """Pointers (surface_id, u, p, a) doubled until they all end at roots."""
    while True:
        up = parent.select("surface_id", F.col("u").alias("p"), F.col("p").alias("_p"), F.col("a").alias("_a"))
        after = cut(joined(parent, up, ["surface_id", "p"], "left").select("surface_id", "u", F.coalesce("_p", "p").alias("p"), F.col("a").bitwiseXOR(F.coalesce("_a", F.lit(0))).alias("a"), (F.col("_p").isNotNull() & (F.col("_p") != F.col("p"))).alias("moved")))
        parent = after.drop("moved")
        if after.filter("moved").isEmpty():
            return parent


def orient(facets: DataFrame) -> DataFrame:
    """(surface_id, fid, component, flip, orientable) of facets (surface_id, fid, vids).

    A component is known by its least fid, which isn't flipped; ``flip`` says which
    facets to turn so that all agree with it. A component with a contradiction (as
    a Moebius strip has) isn't orientable, and its flips follow one of the ways.
    """
    edges = cut(adjacency(facets))
    roots = edges.select("surface_id", "u", "v", "s")
    whole = facets.select("surface_id", F.col("fid").alias("u")).distinct()
    parent = whole.select("surface_id", "u", F.col("u").alias("p"), F.lit(0).alias("a"))
    while not roots.isEmpty():
        # Each root that has a smaller neighbour hooks onto the least of them.
        hooks = roots.groupBy("surface_id", F.col("v").alias("u")).agg(F.min(F.struct(F.col("u").alias("p"), "s")).alias("h")).select("surface_id", "u", "h.p", F.col("h.s").alias("a"))
        flat = _jumped(cut(hooks))
        to = flat.select("surface_id", F.col("u").alias("p"), F.col("p").alias("_p"), F.col("a").alias("_a"))
        parent = cut(joined(parent, to, ["surface_id", "p"], "left").select("surface_id", "u", F.coalesce("_p", "p").alias("p"), F.col("a").bitwiseXOR(F.coalesce("_a", F.lit(0))).alias("a")))
        ends = roots
        for end in ("u", "v"):
            moved = flat.select("surface_id", F.col("u").alias(end), F.col("p").alias(f"_{end}"), F.col("a").alias("_a"))
            ends = joined(ends, moved, ["surface_id", end], "left").withColumn("s", F.col("s").bitwiseXOR(F.coalesce("_a", F.lit(0)))).withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}", "_a")
        ends = ends.filter("u <> v").select("surface_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "s")
        roots = cut(ends.distinct())
    sides = edges
    for end in ("u", "v"):
        sides = joined(sides, parent.select("surface_id", F.col("u").alias(end), F.col("p").alias("component"), F.col("a").alias(f"_{end}")).drop(*(["component"] if end == "v" else [])), ["surface_id", end])
    wrong = sides.filter(F.col("_u").bitwiseXOR(F.col("_v")) != F.col("s")).select("surface_id", "component").distinct().withColumn("wrong", F.lit(True))
    out = parent.select("surface_id", F.col("u").alias("fid"), F.col("p").alias("component"), (F.col("a") == 1).alias("flip"))
    return joined(out, wrong, ["surface_id", "component"], "left").select(*FACET, "component", "flip", F.col("wrong").isNull().alias("orientable"))


def oriented(facets: DataFrame) -> DataFrame:
    """The facets with those turned that ``orient`` says to flip."""
    turned = joined(facets, orient(facets).select(*FACET, "flip"), FACET)
    return turned.withColumn("vids", F.when(F.col("flip"), F.reverse("vids")).otherwise(F.col("vids"))).select(*facets.columns)
