"""Connected components of a link table, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _tidy(edges: DataFrame) -> DataFrame:
    """edges(u, v) without loops, nulls and repeats, the smaller end first."""
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u, v): component is the smallest node that links reach.

    In each round every node points to its smallest neighbour, or to itself if that is smaller, and then to what that
    points to; the ends of the links are replaced by these, which leaves few links for the next round. Each round is
    written to the shared folder. The sides of a join are plain tables, so adaptive execution can split the keys of
    very large components; minima are combined before the shuffle. Null ends are dropped; loops and repeated links do
    no harm.
    """
    left, labels = materialize(_tidy(edges), "links"), None
    for _ in range(max_rounds):
        ends = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")).select("node", F.least("node", "low").alias("low"))
        near = materialize(near, "near")
        points = materialize(near.join(near.select(F.col("node").alias("low"), F.col("low").alias("far")), "low").select("node", F.col("far").alias("low")), "points")
        if labels is None:
            labels = points.select("node", F.col("low").alias("component"))
        else:
            moved = labels.join(points.withColumnRenamed("node", "component"), "component", "left")
            labels = materialize(moved.select("node", F.coalesce("low", "component").alias("component")), "labels")
        to = lambda end: points.select(F.col("node").alias(end), F.col("low").alias(f"{end}_low"))  # noqa: B023,E731
        left = left.join(to("u"), "u").join(to("v"), "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
        left = materialize(_tidy(left), "links")
        if not left.limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
