"""Connected components of an edge table, by alternating large and small stars.

Every round joins edges with the least neighbour of each node and checkpoints what it makes; after a few
rounds all edges are stars around the least node of their component. No edge or label reaches the driver.
The least neighbours are kept before the join, so that both its sides are exchanges and adaptive execution
splits the edges of a node with very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import cut

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether all (a, b) edges are stars: no node has two edges down, and none that is a root has one."""
    ends = F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return nodes.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected (a, b) edges that is not its own root.

    Roots are the least nodes of their components. Loops, repeated and null edges are ignored.
    """
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")))
        # large star: every greater neighbour meets the least of the neighbourhood
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        # small star: a node and its lesser neighbours meet the least of them
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        now = cut(joined.select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
