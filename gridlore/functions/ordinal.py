"""Order-preserving encodings of scalars to unsigned 32-bit coordinates, held in bigint."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET = 1 << 31


def encode_i32(value: Column) -> Column:
    return value.cast("int").cast("long") + F.lit(OFFSET)


def decode_i32(coord: Column) -> Column:
    return (coord - F.lit(OFFSET)).cast("int")


def float_coords(values: np.ndarray) -> np.ndarray:
    """IEEE 754 total order as unsigned integers: negative values have all bits flipped, others the sign."""
    f = values.astype(np.float32)
    if np.isnan(f).any():
        raise ValueError("NaN has no place in the order")
    raw = f.view(np.uint32)
    return np.where(raw >> 31 == 1, ~raw, raw | np.uint32(OFFSET)).astype(np.int64)


def coord_floats(coords: np.ndarray) -> np.ndarray:
    raw = coords.astype(np.uint32)
    return np.where(raw >> 31 == 1, raw ^ np.uint32(OFFSET), ~raw).astype(np.uint32).view(np.float32)


@F.pandas_udf(T.LongType())
def _encode_f32(values: pd.Series) -> pd.Series:
    known = values.notna().to_numpy()
    out = np.zeros(len(values), np.int64)
    out[known] = float_coords(values.to_numpy()[known])
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.FloatType())
def _decode_f32(coords: pd.Series) -> pd.Series:
    known = coords.notna().to_numpy()
    out = np.zeros(len(coords), np.float32)
    out[known] = coord_floats(coords.to_numpy()[known].astype(np.int64))
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.LongType())
def _checked_f32(values: pd.Series, is_nan: pd.Series) -> pd.Series:
    if is_nan.any():
        raise ValueError("NaN has no place in the order")
    return _encode_f32.func(values)


def encode_f32(value: Column) -> Column:
    """Coordinate of a float; NaN is an error. The sign of zero counts: -0.0 lies just below 0.0."""
    return _checked_f32(value.cast("float"), F.coalesce(F.isnan(value), F.lit(False)))


def decode_f32(coord: Column) -> Column:
    return _decode_f32(coord.cast("long"))


def encode_enum(value: Column, names: Sequence[str]) -> Column:
    """Position of the name in the list; null for others."""
    out = F.lit(None).cast("long")
    for i, name in enumerate(names):
        out = F.when(value == name, F.lit(i).cast("long")).otherwise(out)
    return out
