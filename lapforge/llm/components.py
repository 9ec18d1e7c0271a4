"""Connected components of a large edge table by randomised contraction.

Each round every node joins the neighbour (or itself) whose seeded hash is least, edges move
to the joined nodes, and equal or closed edges go. A round leaves a constant share of the
nodes, whatever the shape (long chains too), so rounds grow with the logarithm. Every round
is a staged table; nothing is collected but the count of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) of longs to (node, component): the component is the least node reachable.
    Loops and nulls are ignored; nodes without edges are absent."""
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        # a hash holds for two rounds: what a star's centre joins in the first is its least leaf in the second
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps) // 2)).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
        step = stage(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["n"].alias("to")), "step")
        to = lambda c: step.select(F.col("a").alias(c), F.col("to").alias(f"{c}2"))  # noqa: E731, B023
        moved = live.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        after = stage(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        drop_stage(live)
        steps, live = [*steps, step], after
    if not steps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.select(F.col("a").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    roots = stage(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return stage(roots.join(least, "root").select("node", "component"), "components")
