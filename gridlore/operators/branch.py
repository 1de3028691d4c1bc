"""Branches: lineage and reading a fork."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.operators.scan import scan_live
from gridlore.storage import cut

#: Longest chain of forks followed.
MOST_FORKS = 64


def lineage(branches: DataFrame) -> DataFrame:
    """(branch, ancestor, depth) from (id, parent, ...); a branch is its own ancestor at depth 0."""
    edges = branches.select("id", "parent")
    step = edges.select(F.col("id").alias("branch"), F.col("id").alias("ancestor"), "parent")
    out = step.select("branch", "ancestor", F.lit(0).alias("depth"))
    for depth in range(1, MOST_FORKS):
        up = step.where("parent IS NOT NULL").select("branch", F.col("parent").alias("id"))
        step = cut(up.join(edges, "id").select("branch", F.col("id").alias("ancestor"), "parent"))
        if step.isEmpty():
            break
        out = out.union(step.select("branch", "ancestor", F.lit(depth).alias("depth")))
    return out


def read_branch(base: DataFrame, own: DataFrame, key: list[str], forked_at: int) -> DataFrame:
    """Current state of a branch: its base up to the fork, and its own versions since."""
    return scan_live(base.where(F.col("revision") <= forked_at).unionByName(own), key)
