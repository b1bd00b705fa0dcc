"""Connected components of a graph that is too large for one task: alternating large-star and small-star steps.

Each step is a group minimum (with map-side partial minima) joined back to the edges, so a hub
with very many neighbours is never gathered in one task; the join of a hub's edges is one that
adaptive execution splits. Steps are written in the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def _step(edges: DataFrame, small: bool) -> DataFrame:
    """small: link each node and its smaller neighbours to the smallest. Else: link its larger neighbours to the smallest of all."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u long, v long): component is the smallest node reachable."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    was = _summary(now)
    while was[0]:
        large = materialize(_step(now, small=False), "edges")
        small = materialize(_step(large, small=True), "edges")
        is_now = _summary(small)
        discard(large)
        discard(now)
        now = small
        if is_now == was:
            break
        was = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
