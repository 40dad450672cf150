"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, scope


def components(edges: DataFrame, after: Callable[[], None] = lambda: None) -> DataFrame:
    """edges (u, v): longs, any direction, loops and repeats allowed. Returns (u, v): each vertex that has an edge to
    another and isn't the least of its component, with that least vertex. after: called after each step.

    Every step only joins vertices with their least neighbour, so a star with a third of all vertices stays a list of
    edges; its centre is a hot join key, which adaptive execution splits. O(log^2 n) steps."""
    with scope(edges.sparkSession) as keep:
        e, now = _told(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        seen = None
        while now != seen and now["n"]:
            seen = now
            both = e.union(e.select("v", "u"))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # small star: every u > v is joined to u's least neighbour, and so are its other smaller neighbours
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
            e, now = _told(small)
            after()
        keep(e)
    return e


def _told(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, written, and their number and a sum of their hashes, which tell whether a step changed anything."""
    seen = Observation()
    made = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")), "edges")
    return made, seen.get
