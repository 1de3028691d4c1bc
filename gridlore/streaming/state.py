"""Latest state kept up to date from an append-only log, and clocks over streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from gridlore.functions.clock import MOST_LOGICAL
from gridlore.operators.scan import latest
from gridlore.storage import checkpoint_dir

Project = Callable[[DataFrame], DataFrame]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """The log, a folder or one file, as a stream of Parquet files."""
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file is taken too
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(either)


def maintain_latest(stream: DataFrame, key: list[str], folder: str, *, interval: str | None = None) -> StreamingQuery:
    """Upserts the latest version of each address into ``folder/state/<batch>``.

    A batch folds into the state of the one before it and is written whole under its own number, so a
    repeated batch gives the same files; versions may come late, as order is by revision alone. The state
    before is kept for that, older ones are deleted. Without an interval the query ends when it has read
    what is there.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = state_path(spark, folder, number)
        merged = batch if old is None else batch.unionByName(spark.read.schema(batch.schema).parquet(old))
        latest(merged, key).write.mode("overwrite").parquet(f"{folder}/state/{number}")
        if old is not None:
            prune(spark, folder, int(old.rsplit("/", 1)[1]))

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def state_path(spark: SparkSession, folder: str, before: int | None = None, *, name: str = "state", versioned: bool = True) -> str | None:
    """The newest complete state, or the newest of a batch below ``before``; a folder without versions is itself."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    if not versioned:
        return f"{folder}/{name}"
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = [n for n in numbers if before is None or n < before]
    return f"{folder}/{name}/{max(numbers)}" if numbers else None


def prune(spark: SparkSession, folder: str, below: int) -> None:
    """Deletes the states of numbers below ``below``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(root):
        if int(s.getPath().getName()) < below:
            fs.delete(s.getPath(), True)


def latest_from_log(spark: SparkSession, path: str, schema: StructType, project: Project, key: list[str]) -> DataFrame:
    """Runs the log that is there through ``maintain_latest`` and returns the state."""
    folder = scratch(spark, "latest")
    shaped = project(read_log(spark, path, schema))
    maintain_latest(shaped, key, folder).awaitTermination()
    found = state_path(spark, folder)
    return spark.read.schema(shaped.schema).parquet(found) if found else spark.createDataFrame([], shaped.schema)


CLOCK = "node long, now long, physical_ms long, logical int"
COLUMNS = ["node", "now", "physical_ms", "logical"]


def _clock(events: DataFrame, columns: dict[str, str], move: Callable[[tuple[int, int], tuple], tuple[int, int]]) -> DataFrame:
    """A clock per node as keyed state, moved by each event of a micro-batch in the order of its columns."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else (0, 0)
        # a node's events of one micro-batch: three numbers each, of all its frames
        waiting = sorted(x for frame in frames for x in zip(*(frame[c].astype(int).tolist() for c in list(columns)[1:])))
        rows = []
        for event in waiting:
            at = move(at, event)
            rows.append((key[0], event[0], *at))
        state.update(at)
        yield pd.DataFrame(rows, columns=COLUMNS)

    slim = events.select(*[F.col(c).cast("long").alias(a) for a, c in columns.items()])
    return slim.groupBy("node").applyInPandasWithState(advance, CLOCK, "physical long, logical int", "append", GroupStateTimeout.NoTimeout)


def ticked(at: tuple[int, int], event: tuple) -> tuple[int, int]:
    physical, logical = at
    return (event[0], 0) if event[0] > physical else (physical, min(logical + 1, MOST_LOGICAL))


def received(at: tuple[int, int], event: tuple) -> tuple[int, int]:
    """The clock after a message: past its own time, the wall clock and the message's, with a count within one value."""
    (physical, logical), (wall, remote, count) = at, event
    top = max(physical, wall, remote)
    same = [c for p, c in ((physical, logical), (remote, count)) if p == top]
    return top, min(max(same) + 1, MOST_LOGICAL) if same else 0


def tick_stream(events: DataFrame, node: str, now: str) -> DataFrame:
    """(node, now, physical_ms, logical) of a stream of local events: a hybrid logical clock per node as keyed state.

    Events of a node are taken in the order of their wall clock inside a micro-batch, whatever its frames.
    """
    return _clock(events, {"node": node, "now": now}, ticked)


def receive_stream(messages: DataFrame, node: str, now: str, remote_ms: str, remote_logical: str) -> DataFrame:
    """tick_stream for messages received, each with the sender's clock; ordered by wall clock, then that."""
    return _clock(messages, {"node": node, "now": now, "remote": remote_ms, "count": remote_logical}, received)
