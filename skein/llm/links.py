"""Connected components over distributed links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import forget, stash


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    First each node points at its smallest neighbour below it, which leaves links
    among those targets only; they are joined by alternating large and small
    stars. Minima are combined before every shuffle, skewed joins are left to
    adaptive execution, and every round is a written table.
    """
    start = stash(_distinct(edges), "links")
    near = start.groupBy("a").agg(F.min("b").alias("m"))
    targets = start.select(F.col("b").alias("a")).distinct()
    moved = start.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    among = stash(_distinct(moved.unionByName(targets.join(near, "a").select("a", F.col("m").alias("b")))), "links")
    seen = None
    for _ in range(most_rounds):
        now = among.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now.n == 0 or now == seen:
            break
        seen, before = now, among
        among = stash(_small_star(_large_star(before)), "links")
        forget(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Nodes below nobody are the targets; they end at their star's centre.
    ends = among.groupBy(F.col("a").alias("m")).agg(F.min("b").alias("end"))
    below = near.select(F.col("a").alias("node"), "m")
    tops = targets.join(near, "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("m"))
    return below.unionByName(tops).join(ends, "m", "left").select("node", F.coalesce("end", "m").alias("root"))
