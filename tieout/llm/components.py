"""Connected components of an edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.frames import stored


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b: long); component is the smallest node reachable.

    Each round points every node at the smallest of itself and its neighbours and
    keeps the edges between different targets. Only minima and joins on nodes
    are shuffled, so no neighbourhood is ever gathered. Rounds grow with the
    logarithm of a component's width. Null ends and loops are ignored; repeated
    edges count once; without edges the result is empty.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = stored(e, f"{name}-edges")
    levels: list[DataFrame] = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        up = stored(up, f"{name}-up")
        levels.append(up)
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        e = e.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = stored(e, f"{name}-edges")
        if e.isEmpty():
            break
    out = levels[0].select("node", F.col("up").alias("component"))
    for up in levels[1:]:
        step = up.select(F.col("node").alias("component"), "up")
        out = out.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return stored(out, name) if len(levels) > 1 else out
