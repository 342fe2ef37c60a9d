"""Connected components of an edge table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge to another: columns ``node``, ``component``.

    The graph is contracted round by round: each node merges into the one of least hash among itself and its neighbours, and edges
    are rewritten, so those within a merged set vanish and the rest shrink by a constant factor, whatever order a chain has. Each round's
    tables are in the shared folder. No edges: no rows. Null ends and loops are ignored.
    """
    ordered = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    left, labels = materialize(ordered.distinct(), "edges"), None
    while not left.isEmpty():
        ends = left.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionAll(left.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("to"))).alias("m"))
        into = F.least(F.col("m"), F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("to")))
        into = materialize(least.select("node", into["to"].alias("into")), "into")
        if labels is None:
            labels = into.select("node", F.col("into").alias("label"))
        else:
            labels = materialize(labels.join(into.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")
        old = left
        moved = left.join(into.toDF("hi", "x"), "hi").join(into.toDF("lo", "y"), "lo").where("x <> y")
        left = materialize(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
        discard(old)
    if labels is None:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return materialize(labels.join(smallest, "label").select("node", "component"), "components")
