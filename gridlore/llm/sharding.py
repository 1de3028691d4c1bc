"""Uniform random sharding with exact shard sizes through a hypergeometric communication matrix.

A distributed random permutation needs no global sort. Rows fall into logical partitions by a hash of their
place in the input, which equal rows do not share. How many rows of each partition go to each shard is drawn
*exactly* from the multivariate hypergeometric law, so shard sizes are exact before a row moves. Each
partition permutes its rows locally and cuts the permuted run at the drawn counts; after the exchange every
shard permutes again in small tiles, whose offsets turn local ranks into gapless slots.

Native DataFrame operations only; the driver draws a ``partitions x shards`` matrix of counts.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import carried, cut, seeded

#: Rows of a logical partition or tile, of which there are LEAST_BLOCKS and LEAST_TILES at least.
BLOCK_ROWS = 1 << 17
LEAST_BLOCKS, LEAST_TILES = 2048, 512
NUMPY_ITEMS = 1_000_000_000
#: Broadcast bound of either table, in cells; above it the join is shuffled.
MAX_BROADCAST_CELLS = 1 << 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw of the number of good items; numpy's sampler ends at 10^9 items.

    Beyond, the distribution is inverted around its mode: the mass ratios of neighbours are accumulated in floating point from the mode outwards; what lies
    beyond 40 standard deviations (under 1e-300) is not representable anyway.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if total < NUMPY_ITEMS:
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = (draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5
    reach = int(40 * spread) + 60
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rise = np.cumsum(np.log((good - up) * (draws - up)) - np.log((up + 1) * (bad - draws + up + 1)))
    fall = np.cumsum(np.log(down * (bad - draws + down)) - np.log((good - down + 1) * (draws - down + 1)))
    mass = np.exp(np.concatenate([fall[::-1], [0.0], rise]))
    at = int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), side="right"))
    return int(mode - len(fall) + min(at, len(mass) - 1))


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Random matrix with the given row and column sums, with the law of a uniform permutation."""
    if sum(rows) != sum(shards):
        raise ValueError("row and column sums differ")
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(rows), len(shards)), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for s, good in enumerate(left):
            if not n:
                break
            take = hypergeometric(rng, good, rest - good, n)
            out[i, s] = take
            rest -= good
            n -= take
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def _frame(spark, rows: list, schema: str) -> DataFrame:
    """A small driver-side table as one JSON literal, parsed and exploded in the JVM."""
    literal = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(literal).alias("r")).select("r.*")


def shuffle_into_shards(docs: DataFrame, n_shards: int, *, seed: int = 7, stable: bool = False, blocks: int | None = None, tiles: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 per shard).

    Shard sizes differ by at most one. Every row, repeats of another included, has a random place of its
    own. Nulls, empty and long texts and repeated rows are ordinary rows; an empty table gives an empty
    result. Columns named ``shard`` or ``slot`` are replaced, any other name is kept.

    A row is known by its place in the input, which has to be the same whenever a task is run again.
    ``stable`` says that it is (files or a checkpoint, with no shuffle after them); else the rows are
    written to the checkpoint folder first. Reruns over the same files agree.
    """
    spark = docs.sparkSession
    inner, back = carried(docs, docs.columns, ["shard", "slot"])
    base = docs.select(*inner)
    placed = (base if stable else cut(base)).withColumn("at", F.monotonically_increasing_id())
    total = placed.count()
    if not total:
        return base.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")}).limit(0).select(*back, "shard", "slot")
    blocks = blocks or max(LEAST_BLOCKS, -(-total // BLOCK_ROWS))
    tiles = tiles or max(LEAST_TILES, -(-total // (n_shards * BLOCK_ROWS)))
    placed = placed.withColumn("h", seeded(seed, F.col("at"))).withColumn("b", F.pmod("h", F.lit(blocks)).cast("int"))
    counts = [0] * blocks
    for r in placed.groupBy("b").count().collect():  # a count for each logical partition
        counts[r["b"]] = r["count"]
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cuts = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    bounds = _frame(spark, [{"b": b, "cuts": [int(x) for x in cuts[b]]} for b in range(blocks) if counts[b]], "b:int,cuts:array<bigint>")
    if blocks * n_shards <= MAX_BROADCAST_CELLS:
        bounds = F.broadcast(bounds)
    local = Window.partitionBy("b").orderBy(seeded(seed + 1, F.col("h")), "h", "at")
    sent = (
        placed.withColumn("r", F.row_number().over(local) - 1)
        .join(bounds, "b")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("r"))))
        .withColumn("t", F.pmod(seeded(seed + 2, F.col("h")), F.lit(tiles)).cast("int"))
        .drop("cuts", "r", "b")
    )
    in_shard = Window.partitionBy("shard").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "t").agg(F.count("*").alias("n")).withColumn("o", F.coalesce(F.sum("n").over(in_shard), F.lit(0))).drop("n")
    if n_shards * tiles <= MAX_BROADCAST_CELLS:
        offsets = F.broadcast(offsets)
    again = Window.partitionBy("shard", "t").orderBy(seeded(seed + 3, F.col("h")), "h", "at")
    return (
        sent.withColumn("k", F.row_number().over(again) - 1)
        .join(offsets, ["shard", "t"])
        .withColumn("slot", (F.col("o") + F.col("k")).cast("long"))
        .select(*back, "shard", "slot")
    )
