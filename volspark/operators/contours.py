"""Closed contours of a plane cut, by list ranking.

A triangle that the plane cuts links two of its edges; an edge is known by its
vertices, so both triangles at it name the same point. Links run from where the
boundary goes from the positive side to the negative one, so each point of a
closed, consistently oriented mesh has one follower. Pointer doubling then finds
the least point of each loop and the steps to it, in as many joins as the
logarithm of the longest list; no loop is ever in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.surface import XYZ
from volspark.plans.state import cut, joined

#: Vertices are below this number, so that an edge is one whole number.
VERTICES = 1 << 31
NODE = ["surface_id", "node"]


def links(triangles: DataFrame, point: Sequence[float], normal: Sequence[float]) -> DataFrame:
    """(surface_id, node, next, x, y, z) of triangles with corners (a, b, c, ax..cz): points of the cut with the one that follows; a corner on the plane counts as positive."""
    side = {k: sum(((F.col(k + a) - float(p)) * float(n) for a, p, n in zip(XYZ, point, normal, strict=True)), F.lit(0.0)) for k in "abc"}
    rows = triangles.withColumns({f"_s{k}": s for k, s in side.items()})

    def edge(p: str, q: str) -> Column:
        """The point of an edge, taken from its smaller vertex, so that both triangles get the same."""
        swap = F.col(p) > F.col(q)
        low, high = (F.when(swap, F.col(f"_s{x}")).otherwise(F.col(f"_s{y}")) for x, y in ((q, p), (p, q)))
        at = [F.when(swap, F.col(q + a)).otherwise(F.col(p + a)) for a in XYZ]
        to = [F.when(swap, F.col(p + a)).otherwise(F.col(q + a)) for a in XYZ]
        t = low / (low - high)
        return F.struct((F.least(p, q).cast("long") * VERTICES + F.greatest(p, q)).alias("node"), *[(u + t * (v - u)).alias(a) for u, v, a in zip(at, to, XYZ, strict=True)])

    pairs = (("a", "b"), ("b", "c"), ("c", "a"))
    up = lambda k: F.col(f"_s{k}") >= 0
    start = F.coalesce(*[F.when(up(p) & ~up(q), edge(p, q)) for p, q in pairs])
    end = F.coalesce(*[F.when(~up(p) & up(q), edge(p, q)) for p, q in pairs])
    found = rows.select("surface_id", start.alias("s"), end["node"].alias("next")).filter("s IS NOT NULL")
    return found.select("surface_id", "s.node", "next", *[F.col(f"s.{a}").alias(a) for a in XYZ])


def loops(linked: DataFrame) -> DataFrame:
    """(surface_id, loop, place, x, y, z) of links: the least point of each closed list, and the steps from it, from 0.

    Points of lists that are open (a mesh with a border or mixed orientations) are left out.
    """
    linked = cut(linked)
    longest = linked.groupBy("surface_id").count().agg(F.max("count")).first()[0] or 0
    rounds = max(1, int(longest - 1).bit_length() + 1) if longest else 0
    ends = linked.select("surface_id", F.col("node").alias("next"))
    state = joined(linked, ends, ["surface_id", "next"], "left_semi").select(*NODE, F.col("next").alias("hop"), F.col("node").alias("loop"))
    for _ in range(rounds):
        there = state.select("surface_id", F.col("node").alias("hop"), F.col("hop").alias("_hop"), F.col("loop").alias("_loop"))
        # A point whose way ends has none to follow, and leaves the table.
        state = cut(joined(state, there, ["surface_id", "hop"]).select(*NODE, F.col("_hop").alias("hop"), F.least("loop", "_loop").alias("loop")))
    steps = joined(linked, state.select(*NODE, "loop"), NODE).select(*NODE, "loop", F.when(F.col("next") != F.col("loop"), F.col("next")).alias("hop"), F.lit(1).cast("long").alias("d"))
    for _ in range(rounds):
        there = steps.select("surface_id", F.col("node").alias("hop"), F.col("hop").alias("_hop"), F.col("d").alias("_d"))
        after = joined(steps, there, ["surface_id", "hop"], "left")
        steps = cut(after.select(*NODE, "loop", F.col("_hop").alias("hop"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
    lengths = steps.groupBy("surface_id", "loop").agg(F.count("*").alias("_n"))
    placed = joined(steps, lengths, ["surface_id", "loop"]).select(*NODE, "loop", (F.col("_n") - F.col("d")).alias("place"))
    return joined(linked, placed, NODE).select("surface_id", "loop", "place", *XYZ)


def contours(triangles: DataFrame, point: Sequence[float], normal: Sequence[float]) -> DataFrame:
    """(surface_id, loop, place, x, y, z): the ordered points of each closed contour of a plane cut."""
    return loops(links(triangles, point, normal))
