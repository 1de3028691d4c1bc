"""Comparing two holders of a space, snapshots as messages, and what a bounded cache would keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.operators.join import apply_delta, delta
from gridlore.operators.merkle import diff_leaves, root


def differing_blocks(source: DataFrame, target: DataFrame) -> DataFrame | None:
    """None if both hold the same blocks, else the ids at which ``source`` differs from ``target``.

    Both have (block_id, checksum); roots are compared first, leaves only if they differ.
    """
    leaves = [df.select(F.col("block_id").alias("idx"), F.col("checksum").alias("hash")) for df in (source, target)]
    if root(leaves[0]).first()["hash"] == root(leaves[1]).first()["hash"]:
        return None
    return diff_leaves(*leaves).withColumnRenamed("idx", "block_id")


def bring_up_to_date(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target's blocks after taking over the source's: a changed block replaces the one of its id."""
    changed = differing_blocks(source, target)
    if changed is None:
        return target
    added, removed = delta(source, target)
    fresh = source.join(changed, "block_id", "left_semi").unionByName(added).distinct()
    return apply_delta(target, fresh, removed)


def encode_snapshot(manifest: DataFrame) -> DataFrame:
    """A manifest as one JSON message a block."""
    return manifest.select(F.to_json(F.struct(*manifest.columns)).alias("message"))


def decode_snapshot(messages: DataFrame, schema: str) -> DataFrame:
    return messages.select(F.from_json("message", schema).alias("m")).select("m.*")


def may_contain(manifest: DataFrame) -> bool:
    """Whether the snapshot lists any block at all; a box can only be ruled out by an empty one."""
    return not manifest.isEmpty()


def cache_residents(blocks: DataFrame, capacity: int, *, last_used: str, size: str) -> DataFrame:
    """The most recently used blocks whose sizes add up to at most the capacity."""
    so_far = Window.orderBy(F.col(last_used).desc(), "block_id").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("running", F.sum(size).over(so_far)).where(F.col("running") <= capacity)
