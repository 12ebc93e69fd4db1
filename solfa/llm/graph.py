"""Connected components as joins and aggregates: alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least of them. large: those above the node; else those below, and itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    # written, so that Spark deals both sides of the join anew and can split a hub's rows
    least = written(near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    linked = near.join(least, "a")
    if large:
        linked = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return linked.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node that it reaches) for each node with an edge to a lesser component; roots are
    left out. Edges may repeat, point either way, or be loops; rows with a null end are no edges."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    now = edges.filter(both & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, before = written(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = written(_star(written(_star(now, True), "edges"), False), "edges")
