"""Read descriptors compiled to lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.model import BadShape, Query, coord_columns
from gridlore.operators.scan import prefixed, scan_live, scan_versions, within


def select_space(df: DataFrame, query: Query, dims: int) -> DataFrame:
    """Rows of the space that the box, prefix and key range admit; all push down to the scan.

    These depend on the address alone, so they may come before the choice of a version.
    """
    columns = coord_columns(dims)
    out = df.where(F.col("space") == query.space)
    if query.box:
        out = out.where(within(columns, query.box.low, query.box.high))
    if query.prefix:
        out = out.where(prefixed(columns, query.prefix))
    if query.key_range:
        if "hkey" not in df.columns:
            raise BadShape("a key range needs a table with curve keys")
        out = out.where(F.col("hkey").between(*query.key_range))
    return out


def compile_versions(df: DataFrame, query: Query, dims: int) -> DataFrame:
    """Every version that the query admits."""
    return scan_versions(select_space(df, query, dims), query.as_of, query.tombstones)


def compile_live(df: DataFrame, query: Query, dims: int) -> DataFrame:
    """The current state of every address that the query admits."""
    return scan_live(select_space(df, query, dims), coord_columns(dims), query.as_of, query.tombstones)
