"""Shared pieces of the training-data operators: word splitting, shared storage, seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.storage import checkpoint_dir, cut

__all__ = ["carried", "checkpoint_dir", "cut", "hot_join", "n_words", "quoted", "seeded", "table", "text_key", "without_keys"]

#: A word is a maximal run of characters outside space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, names: list[str], made: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns of ``df`` under internal names c0, c1, ..., and the way back to their own.

    Internal work then meets no column of the same name. A column named like one of ``made``, the columns
    that an operator adds, gives way to it.
    """
    taken = {m.lower() for m in made}
    keep = [c for c in dict.fromkeys(names) if c.lower() not in taken]
    return [df[quoted(c)].alias(f"c{i}") for i, c in enumerate(keep)], [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]


def seeded(seed: int, *cols: Column) -> Column:
    """64-bit hash of the columns that differs by seed."""
    return F.xxhash64(F.lit(seed), *cols)


def text_key(text: Column) -> list[Column]:
    """128-bit digest of a text, null counting as a text of its own."""
    return [seeded(21, text).alias("t1"), seeded(22, text).alias("t2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most keys that are broadcast to drop rows (at most 50 bytes each); more are joined by shuffle.
MAX_BROADCAST_KEYS = 500_000


def without_keys(docs: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``docs`` whose columns ``on`` equal, nulls as values, no row of ``gone``."""
    gone = cut(gone.distinct().toDF(*[f"__gone{i}" for i in range(len(on))]))
    if gone.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        gone = F.broadcast(gone)
    same = [docs[quoted(c)].eqNullSafe(gone[f"__gone{i}"]) for i, c in enumerate(on)]
    return docs.join(gone, same, "left_anti")


#: A key with more than this share of the rows of a join, and this many, is hot.
HOT_SHARE, HOT_ROWS = 1 / 256, 1024


def hot_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many`` joined with ``one``, which has one narrow row for each ``key`` and the number of its rows in ``many`` as ``m``.

    Rows of hot keys do not meet in one task: there are at most 256 such keys, whose rows of ``one`` are
    broadcast. The others are joined by shuffle.
    """
    total = F.broadcast(one.agg(F.greatest(F.sum("m") * HOT_SHARE, F.lit(HOT_ROWS)).alias("__bound")))
    judged = one.crossJoin(total).withColumn("__hot", F.col("m") > F.col("__bound")).drop("m", "__bound")
    hot, one = F.broadcast(judged.where("__hot").drop("__hot")), judged.where("NOT __hot").drop("__hot")
    return many.join(hot.select(key), key, "left_anti").join(one, key).unionByName(many.join(hot, key))
