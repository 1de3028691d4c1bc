"""Hilbert-curve keys (Skilling, 2004) as Column expressions and as numpy.

Keys of at most 62 bits are a ``bigint`` built from higher-order functions, without a UDF; wider keys, up
to 128 bits, are 16 big-endian bytes from one vectorised UDF, whose binary order is the key order.
Coordinates are masked to their low ``bits``; ``quantize`` takes the high bits instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlore.model import BadShape

LONG_BITS, MOST_BITS = 62, 128


def _check(dims: int, bits: int) -> None:
    if dims < 1 or bits < 1 or dims * bits > MOST_BITS:
        raise BadShape(f"{dims} dimensions of {bits} bits do not make a key of 1 to {MOST_BITS} bits")


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _turn(state: Column, steps: list[tuple[int, int]]) -> Column:
    """Reflects and swaps the axes at each (bit value, axis) step."""
    plan = F.array(*[F.struct(_long(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def step(x: Column, s: Column) -> Column:
        first, here, p = F.get(x, F.lit(0)), F.get(x, s["i"]), s["q"] - _long(1)
        hit = here.bitwiseAND(s["q"]) != 0
        swap = F.when(hit, _long(0)).otherwise(first.bitwiseXOR(here).bitwiseAND(p))
        flip = F.when(hit, p).otherwise(swap)
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(flip)).when(j == s["i"], v.bitwiseXOR(swap)).otherwise(v))

    return F.aggregate(plan, state, step) if steps else state


def hilbert_key(coords: list[Column], bits: int) -> Column:
    """Key of the point: bigint up to 62 bits, else binary(16)."""
    n = len(coords)
    _check(n, bits)
    if n * bits > LONG_BITS:
        return _wide(bits)(F.array(*[c.cast("long") for c in coords]))
    mask = _long((1 << bits) - 1)
    start = F.array(*[c.cast("long").bitwiseAND(mask) for c in coords])
    turned = _turn(start, [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)])

    def spread(x: Column) -> Column:
        gray = [F.get(x, F.lit(0))]
        for i in range(1, n):
            gray.append(gray[-1].bitwiseXOR(F.get(x, F.lit(i))))

        def weave(g: Column) -> Column:
            last = F.get(g, F.lit(n - 1))
            t = _long(0)
            for s in range(1, bits):
                t = t.bitwiseXOR(F.shiftright(last, s))

            return _let(t, lambda tt: F.aggregate(
                F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)]), _long(0),
                lambda k, s: F.shiftleft(k, 1).bitwiseOR(F.call_function("shiftright", F.get(g, s["i"]).bitwiseXOR(tt), s["b"]).bitwiseAND(_long(1)))))

        return _let(F.array(*gray), weave)

    return _let(turned, spread)


def hilbert_point(key: Column, dims: int, bits: int) -> Column:
    """The point of a bigint key, as ``array<bigint>``."""
    _check(dims, bits)
    if dims * bits > LONG_BITS:
        raise BadShape("keys over 62 bits are decoded by decode_points")

    def axis(i: int) -> Column:
        out = _long(0)
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(key, b * dims + dims - 1 - i).bitwiseAND(_long(1)), b))
        return out

    def ungray(x: Column) -> Column:
        g = [F.get(x, F.lit(i)) for i in range(dims)]
        return F.array(g[0].bitwiseXOR(F.shiftright(g[-1], 1)), *[g[i].bitwiseXOR(g[i - 1]) for i in range(1, dims)])

    gray = _let(F.array(*[axis(i) for i in range(dims)]), ungray)
    return _turn(gray, [(1 << b, i) for b in range(1, bits) for i in range(dims - 1, -1, -1)])


def quantize(coord: Column, bits: int) -> Column:
    """The high bits of a 32-bit coordinate: order survives, unlike in the low bits a key masks to."""
    return F.shiftright(coord.cast("long"), 32 - bits)


def _numpy_turn(x: np.ndarray, steps) -> None:
    for q, i in steps:
        q = np.uint64(q)
        p = q - np.uint64(1)
        hit = (x[:, i] & q) != 0
        swap = np.where(hit, np.uint64(0), (x[:, 0] ^ x[:, i]) & p)
        x[:, 0] ^= np.where(hit, p, swap)
        if i:
            x[:, i] ^= swap


def encode_points(points: np.ndarray, bits: int) -> list[int]:
    """Keys of (m, n) points as Python integers; the driver's and the wide form."""
    m, n = points.shape
    _check(n, bits)
    x = points.astype(np.uint64) & np.uint64((1 << bits) - 1)
    _numpy_turn(x, [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)])
    x = np.bitwise_xor.accumulate(x, axis=1)
    t = np.zeros(m, np.uint64)
    for s in range(1, bits):
        t ^= x[:, -1] >> np.uint64(s)
    x ^= t[:, None]
    keys = [0] * m
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            column = (x[:, i] >> np.uint64(b)) & np.uint64(1)
            keys = [k << 1 | int(v) for k, v in zip(keys, column)]
    return keys


def decode_points(keys: list[int], dims: int, bits: int) -> np.ndarray:
    """(m, dims) points of the keys."""
    _check(dims, bits)
    x = np.zeros((len(keys), dims), np.uint64)
    for b in range(bits):
        for i in range(dims):
            at = b * dims + dims - 1 - i
            x[:, i] |= np.array([(k >> at) & 1 for k in keys], np.uint64) << np.uint64(b)
    top = x[:, -1] >> np.uint64(1)
    x[:, 1:] ^= x[:, :-1].copy()
    x[:, 0] ^= top
    _numpy_turn(x, [(1 << b, i) for b in range(1, bits) for i in range(dims - 1, -1, -1)])
    return x


def _wide(bits: int):
    @F.pandas_udf("binary")
    def key(points: pd.Series) -> pd.Series:
        if not len(points):
            return pd.Series([], dtype=object)
        return pd.Series([k.to_bytes(16, "big") for k in encode_points(np.stack(points.to_list()), bits)])

    return key


def key_of(point: tuple[int, ...], bits: int) -> int:
    """Key of one corner, on the driver; an empty point has key 0."""
    return encode_points(np.array([point], np.uint64), bits)[0] if point else 0


def covering_ranges(low: tuple[int, ...], high: tuple[int, ...], bits: int, most: int = 32) -> list[tuple[int, int]]:
    """Key intervals that cover a box of ``bits``-bit cells: exact, then merged over the smallest gaps to ``most``.

    Aligned subcubes are contiguous on the curve, so the box is cut into those; a superset of the box's keys
    is safe to AND to the exact box test.
    """
    n = len(low)
    out: list[tuple[int, int]] = []
    stack = [((0,) * n, bits)]
    while stack:
        corner, size = stack.pop()
        end = tuple(c + (1 << size) - 1 for c in corner)
        if any(e < a or c > b for c, e, a, b in zip(corner, end, low, high)):
            continue
        if size == 0 or all(c >= a and e <= b for c, e, a, b in zip(corner, end, low, high)):
            first = key_of(corner, bits) >> (n * size) << (n * size)
            out.append((first, first + (1 << (n * size)) - 1))
            continue
        half = 1 << (size - 1)
        for k in range(1 << n):
            stack.append((tuple(c + half * (k >> i & 1) for i, c in enumerate(corner)), size - 1))
    out.sort()
    merged: list[list[int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    while len(merged) > most:
        k = min(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])
        merged[k - 1][1] = merged[k][1]
        del merged[k]
    return [(a, b) for a, b in merged]


class CompositeKey:
    """Builds a curve key from labelled coordinates; the label is not part of the key."""

    def __init__(self, bits: int = 8):
        self.bits, self.parts = bits, []

    def push(self, label: str, coord: Column) -> CompositeKey:
        if len(self.parts) == 16:
            raise BadShape("a key has at most 16 dimensions")
        self.parts.append((label, coord))
        return self

    def encode(self) -> Column:
        return hilbert_key([c for _, c in self.parts], self.bits)
