"""Blocks: statistics, chunking, compaction, retention, checksums, memory accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.model import CompactionConfig, RetentionPolicy
from gridlore.operators.order import number_rows
from gridlore.operators.scan import latest

#: Accounting estimates: bytes of a record beside its payload, of a block, of a snapshot entry, and fixed.
RECORD_BYTES, BLOCK_BYTES, ENTRY_BYTES, FIXED_BYTES = 48, 64, 24, 4096


def block_stats(df: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Rows, revision range and live share of each block."""
    live = F.avg((~F.col("tombstone")).cast("int"))
    return df.groupBy("block_id").agg(F.count("*").alias("n_rows"), F.min("revision").alias("min_revision"), F.max("revision").alias("max_revision"), live.alias("live_ratio"), *(extra or []))


def has_live_at(df: DataFrame, revision: int) -> DataFrame:
    """Whether each block holds a live version at or below the revision."""
    return df.groupBy("block_id").agg(F.bool_or((F.col("revision") <= revision) & ~F.col("tombstone")).alias("has_live"))


def compact(df: DataFrame, coords: list[str], config: CompactionConfig = CompactionConfig(), tie: list[str] | None = None) -> DataFrame:
    """Versions rewritten in (coordinates, revision) order and numbered into blocks (``block_no``).

    Without history only the latest version of each address stays, tombstones included; dropping those is
    left to retention.
    """
    kept = df if config.retain_history else latest(df, coords, tie)
    numbered = number_rows(kept, [*coords, "revision", *(tie or [])], "__n")
    return numbered.withColumn("block_no", F.floor(F.col("__n") / config.max_records_per_block).cast("long")).drop("__n")


def apply_retention(df: DataFrame, policy: RetentionPolicy, key: list[str] | None = None) -> DataFrame:
    """Drops tombstones below the horizon, and with a version horizon the superseded versions below it."""
    out = df
    if policy.version_horizon and key:
        newest = df.groupBy(*key).agg(F.max("revision").alias("__newest"))
        out = out.join(newest, key).where((F.col("revision") >= policy.version_horizon) | (F.col("revision") == F.col("__newest"))).drop("__newest")
    if policy.tombstone_horizon:
        out = out.where(~F.col("tombstone") | (F.col("revision") >= policy.tombstone_horizon))
    return out


def field_text(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def block_checksums(df: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """SHA-256 of each block's rows in order; a block is bounded by its configuration.

    A field is written as its length in bytes, a colon and its text, null as a minus sign, so that different
    rows have different texts.
    """
    text = F.concat(*[field_text(F.col(c).cast("string")) for c in fields])
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("__row"))))
    return df.groupBy("block_id").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["__row"]), "\n"), 256).alias("checksum"))


def memory_stats(buffer: DataFrame, blocks: DataFrame, manifest: DataFrame, size: Column) -> DataFrame:
    """One row: buffered and cached records and bytes, snapshot entries, and the total estimate."""
    b = buffer.agg(F.count("*").alias("buffer_records"), F.coalesce(F.sum(F.lit(RECORD_BYTES) + size), F.lit(0)).cast("long").alias("buffer_bytes"))
    c = blocks.agg(F.countDistinct("block_id").alias("cached_blocks"), F.coalesce(F.sum(F.lit(RECORD_BYTES) + size), F.lit(0)).cast("long").alias("record_bytes"))
    m = manifest.agg(F.count("*").alias("snapshot_entries"))
    one = b.crossJoin(c).crossJoin(m)  # three single rows
    cache = F.col("record_bytes") + BLOCK_BYTES * F.col("cached_blocks")
    return one.withColumn("cache_bytes", cache).withColumn("total_bytes", F.col("buffer_bytes") + F.col("cache_bytes") + ENTRY_BYTES * F.col("snapshot_entries") + FIXED_BYTES).drop("record_bytes")


def format_bytes(n: Column) -> Column:
    """B, KB with one decimal, MB with two; ties round to even."""
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1)))
        .otherwise(F.format_string("%.2f MB", F.bround(n / F.lit(1048576.0), 2)))
    )
