"""Connected components of a graph of 64-bit nodes by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkgauge.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on distinct edges (a > b); a hub's edges meet only its one-row minimum, so a join can split them."""
    if large:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges
    least = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = ends.join(least, "a")
    if large:
        made = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.filter("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of its component.

    Edges may repeat, point either way and join a node with itself. Each round is
    written to the shared folder; rounds grow with the logarithm of the node count.
    """
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        now = stored(_star(_star(now, True), False), "edges")
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (told["n"], told["s"]) == state:
            break
        state = (told["n"], told["s"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
