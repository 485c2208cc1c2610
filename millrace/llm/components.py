"""Connected components of an edge table, without bringing links or labels to the driver.

Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is a minimum per vertex, combined before the
shuffle, and a join that adaptive execution splits where a vertex has many neighbours. Steps are cut by tables in the
shared folder, so the loss of an executor repeats one step at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import drop_materialized, materialize


def numbered(vertices: DataFrame, name: str = "node") -> DataFrame:
    """vertices with a number for each row. The numbers hold until the frame is computed again: materialize it."""
    return vertices.withColumn(name, F.monotonically_increasing_id())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (u, v): to each u the smallest vertex m of it and its neighbours; v (only those over u if larger) hangs under m."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    out = pairs.join(least, "u")
    if larger:
        return out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    hung = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every vertex that has a link and isn't the smallest of its component; root is that smallest vertex.

    edges: two columns of longs; order, repeats and self-links don't matter. Empty edges give an empty table."""
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True).where("a <> b").distinct()
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        new = materialize(small.where("a <> b").distinct(), "edges")
        drop_materialized(now)
        now = new
        n, digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, digest) == mark or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (n, digest)
