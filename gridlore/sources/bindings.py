"""The driver's tables as spaces of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EV_KEY, LI_KEY, NL_KEY, PT_KEY = ["c0", "c1"], ["c0", "c1", "c2"], ["c0", "c1"], ["c0", "c1"]
#: Rows of an idealised block, and the share of revisions that is sealed.
BLOCK, SEALED = 256, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: users by hour of day; an error deletes. One version an event, in event order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("c0"), F.hour("ts").cast("long").alias("c1"), (F.col("event_id") + 1).alias("revision"),
        (F.col("event_type") == "error").alias("tombstone"), "event_type", "value", "ts",
        F.floor(F.col("event_id") / BLOCK).cast("long").alias("block_id"),
    )


def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV with the state of each version: sealed up to 80% of the revisions, then buffered."""
    ev = events(spark, sf_dir)
    cut = F.floor(F.lit(SEALED) * F.col("most"))
    most = ev.agg(F.max("revision").alias("most"))  # one row
    state = F.when(F.col("revision") <= cut, "sealed").otherwise("buffered")
    return ev.join(F.broadcast(most), F.lit(True)).withColumn("state", state).drop("most")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LI: part, supplier, quantity; wide coordinates, no deletions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("c0"), F.col("l_suppkey").alias("c1"), F.col("l_quantity").cast("long").alias("c2"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line")
    )


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NL: order, line; the lines are a space nested in their order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("c0"), F.col("l_linenumber").cast("long").alias("c1"), F.col("l_partkey").alias("part"), "l_quantity")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PT: size, brand number."""
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("c0"), F.substring("p_brand", 7, 10).cast("long").alias("c1"), F.col("p_partkey").alias("part"))
