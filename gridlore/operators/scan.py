"""Scans of versions: every version, the latest state, and the two buffer-dependent readings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.model import BadShape


def within(columns: list[str], low: tuple[int, ...], high: tuple[int, ...]) -> Column:
    """Inside the box on every axis, both ends included. Plain comparisons of flat columns push to Parquet."""
    if not len(columns) == len(low) == len(high):
        raise BadShape("box and point have different numbers of coordinates")
    return reduce(and_, [F.col(c).between(F.lit(a), F.lit(b)) for c, a, b in zip(columns, low, high)])


def prefixed(columns: list[str], coords: tuple[int, ...]) -> Column:
    """The first coordinates equal the given ones; the others are open."""
    if len(coords) > len(columns):
        raise BadShape("the prefix has more coordinates than the space")
    return reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(columns, coords)], F.lit(True))


def upto(df: DataFrame, as_of: int | None) -> DataFrame:
    return df if as_of is None else df.where(F.col("revision") <= F.lit(as_of))


def scan_versions(df: DataFrame, as_of: int | None = None, tombstones: bool = False) -> DataFrame:
    """Every version up to ``as_of``, without tombstones unless asked for."""
    seen = upto(df, as_of)
    return seen if tombstones else seen.where(~F.col("tombstone"))


def latest(df: DataFrame, key: list[str], tie: list[str] | None = None) -> DataFrame:
    """The version of highest revision of each address, tombstones included."""
    order = [F.col("revision").desc(), *[F.col(c).desc() for c in tie or []]]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def scan_live(df: DataFrame, key: list[str], as_of: int | None = None, tombstones: bool = False) -> DataFrame:
    """Current state: the latest version of each address up to ``as_of``, unless that is a tombstone."""
    now = latest(upto(df, as_of), key)
    return now if tombstones else now.where(~F.col("tombstone"))


def scan_buffered(df: DataFrame, key: list[str], as_of: int | None = None) -> DataFrame:
    """What a write buffer shows: no version of an address with any tombstone up to ``as_of``."""
    seen = upto(df, as_of)
    return seen.where(~F.col("tombstone")).join(seen.where("tombstone").select(*key).distinct(), key, "left_anti")


def scan_faithful(df: DataFrame, key: list[str], state: str, as_of: int | None = None) -> DataFrame:
    """Sealed and buffered versions as one reading: only buffered tombstones hide, and they hide both.

    ``state`` is a column of ``sealed``, ``buffered`` or ``lost``; lost versions are never seen.
    """
    seen = upto(df, as_of).where(F.col(state) != "lost")
    hidden = seen.where((F.col(state) == "buffered") & F.col("tombstone")).select(*key).distinct()
    return seen.where(~F.col("tombstone")).join(hidden, key, "left_anti")


def point_lookup(df: DataFrame, columns: list[str], point: tuple[int, ...], as_of: int | None = None) -> DataFrame:
    """The version visible at one address: at most one row. A top-1, so no shuffle of the history."""
    here = upto(df.where(within(columns, point, point)), as_of)
    return here.orderBy(F.col("revision").desc()).limit(1).where(~F.col("tombstone"))


def history(df: DataFrame, key: list[str]) -> DataFrame:
    """Every version with the interval of revisions in which it is the latest: [revision, valid_to)."""
    w = Window.partitionBy(*key).orderBy("revision")
    return df.withColumns({"previous": F.lag("revision").over(w), "valid_to": F.lead("revision").over(w)})
