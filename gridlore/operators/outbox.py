"""One step of a replication outbox as relations: due batch, results, backoff, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First delay and longest delay.
BASE_MS, MOST_MS = 1000, 60_000


def backoff_ms(attempts: Column) -> Column:
    """2, 4, 8, 16, 32 and then 60 seconds."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(attempts.cast("int"), F.lit(6)))
    return F.least(F.lit(BASE_MS) * power, F.lit(MOST_MS)).cast("long")


def due_batch(outbox: DataFrame, now_ms: int, most: int) -> DataFrame:
    """The first ``most`` entries, by op_id, whose next attempt is due."""
    return outbox.where(F.col("next_attempt_at_ms") <= now_ms).orderBy("op_id").limit(most)


def first_results(results: DataFrame) -> DataFrame:
    """The first response, by position, to each operation."""
    w = Window.partitionBy("op_id").orderBy("position")
    return results.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "position")


def apply_results(outbox: DataFrame, due: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """The outbox after a step: acknowledged and stale operations leave, others wait for their next attempt.

    ``results`` has (op_id, position, result, error), result in ack, retry, conflict_stale; an operation
    without a response is retried.
    """
    met = due.select("op_id").withColumn("__due", F.lit(True)).join(first_results(results), "op_id", "left")
    joined = outbox.join(met, "op_id", "left")
    again = F.col("__due") & F.coalesce(F.col("result"), F.lit("retry")).eqNullSafe("retry")
    attempts = F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts"))
    waited = F.when(again, F.lit(now_ms) + backoff_ms(F.col("attempts") + 1)).otherwise(F.col("next_attempt_at_ms"))
    error = F.when(again, F.coalesce("error", F.lit("no result for this operation"))).otherwise(F.col("last_error"))
    kept = joined.where(F.col("__due").isNull() | again)
    return kept.select(*[{"attempts": attempts.cast("int").alias("attempts"), "next_attempt_at_ms": waited.cast("long").alias("next_attempt_at_ms"), "last_error": error.alias("last_error")}.get(c, F.col(c)) for c in outbox.columns])


def sync_report(due: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts: attempted, acked, retried, dropped_stale."""
    met = due.select("op_id").join(first_results(results), "op_id", "left")
    r = F.coalesce("result", F.lit("retry"))
    return met.agg(
        F.count("*").alias("attempted"), F.count_if(r == "ack").alias("acked"),
        F.count_if(r == "retry").alias("retried"), F.count_if(r == "conflict_stale").alias("dropped_stale"),
    )


def stale(pending: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Pending versions that the remote side has overtaken: last writer wins by revision."""
    newest = remote.groupBy(*key).agg(F.max("revision").alias("remote_revision"))
    return pending.join(newest, key).where(F.col("remote_revision") > F.col("revision"))
