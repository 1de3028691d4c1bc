"""Merkle trees over hashed leaves, level by level, and their differences. Hashes are hex SHA-256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.storage import cut

ZERO = "0" * 64


def hash_pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def padded_size(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def levels(leaves: DataFrame) -> DataFrame:
    """(level, idx, hash) from leaves (idx from 0, hash), padded with zero hashes to a power of two.

    Every level halves the rows of the one below, so all of them together shuffle twice the leaves. No
    leaves: one zero node.
    """
    spark = leaves.sparkSession
    n = leaves.agg(F.max("idx")).first()[0]
    if n is None:
        return spark.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(ZERO).alias("hash"))
    size = padded_size(n + 1)
    now = spark.range(size).withColumnRenamed("id", "idx").join(leaves, "idx", "left").select("idx", F.coalesce("hash", F.lit(ZERO)).alias("hash"))
    out, level = now.select(F.lit(0).alias("level"), "idx", "hash"), 0
    while size > 1:
        level, size = level + 1, size // 2
        left, right = (F.max(F.when(F.col("idx") % 2 == k, F.col("hash"))) for k in (0, 1))
        up = now.groupBy(F.floor(F.col("idx") / 2).cast("long").alias("p")).agg(left.alias("l"), right.alias("r"))
        now = up.select(F.col("p").alias("idx"), hash_pair(F.col("l"), F.col("r")).alias("hash"))
        if level % 8 == 0:
            now = cut(now)
        out = out.union(now.select(F.lit(level).alias("level"), "idx", "hash"))
    return out


#: Levels that one exchange folds: a group has at most 2 ** STEP nodes.
STEP = 6


def zero_hashes(n: int) -> list[str]:
    """Hash of a tree of zero leaves of each height up to ``n``."""
    out = [ZERO]
    while len(out) <= n:
        out.append(hashlib.sha256(bytes.fromhex(out[-1]) * 2).hexdigest())
    return out


def root(leaves: DataFrame) -> DataFrame:
    """The one row of the top level of ``levels``, from the leaves there are.

    A group of 64 neighbours folds into its common ancestor in one step; what holds no leaf has a known
    hash, so padding costs nothing, whatever the largest index.
    """
    n = leaves.agg(F.max("idx")).first()[0]
    if n is None:
        return levels(leaves).select("hash")
    height, zero = (padded_size(n + 1) - 1).bit_length(), zero_hashes(64)
    now, done = leaves.select("idx", "hash"), 0
    while done < height:
        step = min(STEP, height - done)
        place = F.col("idx").bitwiseAND(F.lit((1 << step) - 1))
        group = now.groupBy(F.shiftright("idx", step).alias("up")).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("k"), "hash"))).alias("at"))
        nodes = F.transform(F.sequence(F.lit(0), F.lit((1 << step) - 1)), lambda k: F.coalesce(F.element_at("at", k), F.lit(zero[done])))
        folded = group.withColumn("nodes", nodes)
        for k in range(step - 1, -1, -1):
            folded = folded.withColumn("nodes", F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda i: hash_pair(F.get("nodes", 2 * i), F.get("nodes", 2 * i + 1))))
        now, done = folded.select(F.col("up").alias("idx"), F.get("nodes", F.lit(0)).alias("hash")), done + step
    return now.select("hash")


def diff_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """Indices of leaves of ``a`` whose hash differs in ``b``; trees of other sizes differ in what is missing."""
    return (
        a.select("idx", F.col("hash").alias("ha")).join(b.select("idx", F.col("hash").alias("hb")), "idx", "left")
        .where(F.col("hb").isNull() | (F.col("ha") != F.col("hb"))).select("idx")
    )
