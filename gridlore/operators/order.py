"""Dense numbering of a total order, without a single-task window."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.storage import cut

_ROW = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Adds ``start, start + 1, ...`` in the given total order.

    Rows are range-partitioned by the order and sorted inside partitions; the counts of the partitions (one
    number each) give the offsets, and the position inside a partition completes the number.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = cut(ranged.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW).cast("long"))}))
    counts = {r[0]: r[1] for r in placed.groupBy("__p").count().collect()}
    offsets, total = [], start
    for p in sorted(counts):
        offsets.append({"__p": p, "__o": total})
        total += counts[p]
    table = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(offsets)), "array<struct<__p:int,__o:bigint>>")).alias("r")).select("r.*")
    return placed.join(F.broadcast(table), "__p").withColumn(name, (F.col("__o") + F.col("__i")).cast("long")).drop("__p", "__i", "__o")


def latest_prefix(df: DataFrame, position: str, valid: str) -> DataFrame:
    """The longest prefix, by position, of valid rows: those before the first invalid one."""
    first_bad = df.where(~F.coalesce(F.col(valid), F.lit(False))).agg(F.min(position).alias("__bad"))
    return df.join(F.broadcast(first_bad), (F.col(position) < F.col("__bad")) | F.col("__bad").isNull()).drop("__bad")


def coverage_gaps(blocks: DataFrame, space: str = "space") -> DataFrame:
    """Each block with the first key of the next one of its space."""
    return blocks.withColumn("next_hkey", F.lead("hkey_min").over(Window.partitionBy(space).orderBy("hkey_min", "block_id")))
