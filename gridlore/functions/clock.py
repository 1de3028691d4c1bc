"""Hybrid logical clocks: packing, and whole sequences of ticks and receipts as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_LOGICAL = 65535


def pack(physical_ms: Column, logical: Column) -> Column:
    return F.shiftleft(physical_ms.cast("long"), 16).bitwiseOR(logical.cast("long"))


def physical(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 16)


def logical(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")


def to_coord(packed: Column) -> Column:
    """High 32 bits: steps of 65.536 seconds."""
    return F.shiftrightunsigned(packed, 32)


def earlier(a_physical: Column, a_logical: Column, b_physical: Column, b_logical: Column) -> Column:
    """Whether timestamp a comes before b: by physical part, then logical; packed timestamps compare as numbers."""
    return (a_physical < b_physical) | ((a_physical == b_physical) & (a_logical < b_logical))


def tick_sequence(df: DataFrame, *, now: str, order: list[str], node: list[str]) -> DataFrame:
    """Adds (physical_ms, logical) after each local event, in order, of a clock per ``node``.

    The physical part is a running maximum of the wall clock; within one value of it the logical part
    counts, from 0, or from 1 at physical 0 where every clock starts.
    """
    by = Window.partitionBy(*node).orderBy(*order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    stamped = df.withColumn("physical_ms", F.greatest(F.max(now).over(so_far), F.lit(0)).cast("long"))
    at = F.row_number().over(Window.partitionBy(*node, "physical_ms").orderBy(*order))
    count = at - F.when(F.col("physical_ms") > 0, 1).otherwise(0)
    return stamped.withColumn("logical", F.least(count, F.lit(MOST_LOGICAL)).cast("int"))


def receive_sequence(df: DataFrame, *, remote_ms: str, remote_logical: str, now: str, order: list[str], node: list[str]) -> DataFrame:
    """Adds (physical_ms, logical) after each received timestamp, in order, of a clock per ``node``.

    With j the position within one physical value, the logical part is j plus the running maximum of
    (base - j), where the base restarts the count at what the message carried.
    """
    by = Window.partitionBy(*node).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = F.max(F.greatest(F.col(remote_ms), F.col(now))).over(by)
    stamped = df.withColumn("physical_ms", F.greatest(p, F.lit(0)).cast("long"))
    same = Window.partitionBy(*node, "physical_ms").orderBy(*order)
    placed = stamped.withColumn("__j", F.row_number().over(same))
    carried = F.when(F.col(remote_ms) == F.col("physical_ms"), F.col(remote_logical) + 1)
    fresh = F.when(F.col("__j") == 1, F.when(F.col("physical_ms") == 0, 1).otherwise(0))
    base = F.when(F.col("physical_ms") == 0, F.greatest(carried, fresh)).otherwise(F.coalesce(carried, fresh))
    count = F.col("__j") + F.max(base - F.col("__j")).over(same.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("logical", F.least(count, F.lit(MOST_LOGICAL)).cast("int")).drop("__j")
