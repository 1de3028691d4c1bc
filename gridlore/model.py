"""Data model: spaces, versions, boxes, read descriptors, policies, sessions, and their errors.

A space is a set of immutable versions. A version is addressed by integer coordinates, stored as flat
columns ``c0 .. c{n-1}`` so that boxes reach the Parquet scan, and ordered by ``revision``.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

MAX_DIMS = 16
MAX_COORD = 2**32 - 1
#: Rows of a sealed block by default, and rows that fill the write buffer.
BLOCK_ROWS, BUFFER_ROWS = 4096, 256
#: Bits of a coordinate in a standard and in a compact curve key.
STANDARD_BITS, COMPACT_BITS = 8, 4


class GridError(Exception):
    """Base of all errors of this library."""


class DuplicateSpace(GridError):
    """A space of this id or name is registered already."""


class SpaceNotFound(GridError):
    """No such space."""


class DuplicateBranch(GridError):
    """A branch of this name exists already."""


class BranchNotFound(GridError):
    """No such branch."""


class Unauthorised(GridError):
    """The session's grants do not allow the request."""


class BadShape(GridError, ValueError):
    """Coordinates, boxes or keys of the wrong number or size."""


class CorruptBlock(GridError):
    """A block's rows are not those that were sealed."""


def coord_columns(dims: int) -> list[str]:
    if not 1 <= dims <= MAX_DIMS:
        raise BadShape(f"a space has 1 to {MAX_DIMS} dimensions, not {dims}")
    return [f"c{i}" for i in range(dims)]


def version_schema(dims: int, payload: list[T.StructField] | None = None) -> T.StructType:
    """Envelope of a version, followed by typed payload columns."""
    coords = [T.StructField(c, T.LongType(), False) for c in coord_columns(dims)]
    return T.StructType(
        [T.StructField("space", T.LongType(), False), *coords, T.StructField("revision", T.LongType(), False), T.StructField("tombstone", T.BooleanType(), False), *(payload or [])]
    )


@dataclass(frozen=True)
class SpaceConfig:
    id: int
    name: str
    dims: int

    def __post_init__(self):
        coord_columns(self.dims)


@dataclass(frozen=True)
class PointSchema:
    """How rows of a user's own shape become points: a Column for each coordinate, and the payload columns."""

    coords: tuple[Callable[[DataFrame], Column], ...]
    payload: tuple[str, ...] = ()

    def project(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[f(rows).cast("long").alias(c) for f, c in zip(self.coords, coord_columns(len(self.coords)))], *self.payload)


@dataclass(frozen=True)
class SpatialRange:
    """An axis-aligned box, both corners included."""

    low: tuple[int, ...]
    high: tuple[int, ...]

    def __post_init__(self):
        if len(self.low) != len(self.high):
            raise BadShape("the corners of a box have different numbers of coordinates")


@dataclass(frozen=True)
class Query:
    """An immutable description of a read; see ``gridlore.plans.compile``."""

    space: int
    snapshot: int | None = None
    box: SpatialRange | None = None
    prefix: tuple[int, ...] | None = None
    key_range: tuple[int, int] | None = None
    as_of: int | None = None
    tombstones: bool = False

    def with_box(self, low: tuple[int, ...], high: tuple[int, ...]) -> Query:
        return replace(self, box=SpatialRange(tuple(low), tuple(high)))

    def with_prefix(self, *coords: int) -> Query:
        return replace(self, prefix=coords)

    def with_key_range(self, low: int, high: int) -> Query:
        return replace(self, key_range=(low, high))

    def at(self, revision: int) -> Query:
        return replace(self, as_of=revision)

    def include_tombstones(self) -> Query:
        return replace(self, tombstones=True)


@dataclass(frozen=True)
class RetentionPolicy:
    """Tombstones below ``tombstone_horizon`` may go (0: all stay). ``version_horizon`` above 0 also lets
    superseded versions below it go; the latest version of an address always stays."""

    tombstone_horizon: int = 0
    version_horizon: int = 0

    @staticmethod
    def keep_all() -> RetentionPolicy:
        return RetentionPolicy()


@dataclass(frozen=True)
class CompactionConfig:
    max_records_per_block: int = BLOCK_ROWS
    retain_history: bool = True

    def __post_init__(self):
        if self.max_records_per_block < 1:
            raise BadShape("a block holds at least one record")


READ_ONLY, READ_WRITE, ADMIN = "read_only", "read_write", "admin"
LEVELS = (READ_ONLY, READ_WRITE, ADMIN)
WRITERS = (READ_WRITE, ADMIN)


@dataclass(frozen=True)
class SpaceGrant:
    space: int
    level: str

    def __post_init__(self):
        if self.level not in LEVELS:
            raise GridError(f"unknown access level {self.level!r}")


@dataclass(frozen=True)
class Session:
    """Who asks, and what the asker may do in each space; the first grant for a space counts."""

    grants: tuple[SpaceGrant, ...] = ()
    label: str = ""
    id: bytes = field(default_factory=lambda: secrets.token_bytes(16))

    def access(self, space: int) -> str | None:
        return next((g.level for g in self.grants if g.space == space), None)

    def can_write(self, space: int) -> bool:
        return self.access(space) in WRITERS

    @property
    def hex(self) -> str:
        return self.id.hex()
