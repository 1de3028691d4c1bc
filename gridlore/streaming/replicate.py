"""A replication outbox over a log: at-least-once batches, results by operation, backoff, a report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridlore.operators.outbox import apply_results, due_batch, first_results, sync_report
from gridlore.storage import cut
from gridlore.streaming.state import prune, read_log, scratch, state_path

#: Takes the due operations, gives (op_id, position, result, error).
Transport = Callable[[DataFrame], DataFrame]
STATUS = "at_ms long, acked long, error string"
REPORT = "attempted long, acked long, retried long, dropped_stale long"


def acknowledge_all(due: DataFrame) -> DataFrame:
    return due.select("op_id", F.lit(0).alias("position"), F.lit("ack").alias("result"), F.lit(None).cast("string").alias("error"))


def now_ms() -> int:
    return int(time.time() * 1000)


class Outbox:
    """A durable queue of operations in ``folder/state``, one complete version after another; the last two are kept."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | None = None):
        self.spark, self.folder, self.schema = spark, folder, schema

    def load(self) -> DataFrame | None:
        path = state_path(self.spark, self.folder)
        return self.spark.read.parquet(path) if path else None

    def _save(self, df: DataFrame) -> None:
        path = state_path(self.spark, self.folder)
        number = int(path.rsplit("/", 1)[1]) + 1 if path else 0
        df.write.mode("overwrite").parquet(f"{self.folder}/state/{number}")
        prune(self.spark, self.folder, number - 1)

    def enqueue(self, versions: DataFrame, now: int) -> None:
        """Adds one operation a version; its op_id is the revision, so a version enqueued twice counts once."""
        fresh = versions.select(
            F.col("revision").alias("op_id"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("next_attempt_at_ms"),
            F.lit(now).cast("long").alias("created_at_ms"), F.lit(None).cast("string").alias("last_error"), F.struct(*versions.columns).alias("op"),
        )
        old = self.load()
        self._save(fresh if old is None else old.unionByName(fresh.join(old.select("op_id"), "op_id", "left_anti")))

    def pending(self) -> int:
        df = self.load()
        return 0 if df is None else df.count()

    def step(self, transport: Transport, now: int, most: int) -> dict[str, int]:
        """One pass over the due operations; a transport that fails leaves all of them to be retried."""
        df = self.load()
        if df is None:
            return dict.fromkeys(("attempted", "acked", "retried", "dropped_stale"), 0)
        due = cut(due_batch(df, now, most))
        try:
            results = cut(transport(due))
        except Exception as error:  # whatever a transport raises counts as a failed attempt
            results = due.select("op_id", F.lit(0).alias("position"), F.lit("retry").alias("result"), F.lit(str(error)[:500]).alias("error"))
        report = sync_report(due, results).first().asDict()
        if report["attempted"]:
            self._save(apply_results(df, due, results, now))
            error = first_results(results).where(F.col("error").isNotNull()).agg(F.min_by("error", "op_id")).first()[0]
            self.spark.createDataFrame([(now, report["acked"], error)], STATUS).coalesce(1).write.mode("append").parquet(f"{self.folder}/status")
        return report

    def status(self) -> dict[str, object]:
        """Time of the last step that had an acknowledgement, error of the last step if it had one, and what waits."""
        last = (None, None)
        if state_path(self.spark, self.folder, name="status", versioned=False):
            steps = self.spark.read.schema(STATUS).parquet(f"{self.folder}/status")
            last = steps.agg(F.max(F.when(F.col("acked") > 0, F.col("at_ms"))), F.max_by(F.struct("error"), "at_ms")["error"]).first()
        return {"last_success_ms": last[0], "last_error": last[1], "pending": self.pending()}


def run_outbox(versions: DataFrame, transport: Transport, folder: str, *, most: int = 100_000, interval: str | None = None) -> StreamingQuery:
    """Enqueues every micro-batch of a stream and pushes what is due; reports go to ``folder/reports/<batch>``."""
    spark = versions.sparkSession
    queue = Outbox(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        queue.enqueue(batch, now_ms())
        total = dict.fromkeys(("attempted", "acked", "retried", "dropped_stale"), 0)
        while True:
            report = queue.step(transport, now_ms(), most)
            total = {k: v + report[k] for k, v in total.items()}
            if report["attempted"] < most:
                break
        row = batch.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in total.items()])
        row.write.mode("overwrite").parquet(f"{folder}/reports/{number}")

    writer = versions.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain_log(spark: SparkSession, path: str, schema: StructType, project: Callable[[DataFrame], DataFrame], transport: Transport = acknowledge_all) -> DataFrame:
    """Sends the whole log; one row with the number of acknowledged operations."""
    folder = scratch(spark, "outbox")
    run_outbox(project(read_log(spark, path, schema)), transport, folder).awaitTermination()
    return spark.read.schema(REPORT).parquet(f"{folder}/reports/*").agg(F.coalesce(F.sum("acked"), F.lit(0)).alias("sent"))
