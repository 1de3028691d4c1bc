"""A store of spaces under one folder: a log of versions, sealed blocks, snapshots, branches, catalogs.

Layout: ``log/space=<id>/`` holds appended versions that are not sealed; ``blocks/space=<id>/flush=<n>/``
holds sealed ones, clustered by curve key; ``meta/<table>/<version>`` holds the small catalogs, each version
written whole, so that a reader sees one state or the next. The manifest is a log of changes: a snapshot adds
its own blocks and drops those that it replaces, and takes over the others of its parent, so that what is
written does not grow with what is there. One writer at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.hilbert import covering_ranges, hilbert_key
from gridlore.model import (
    MAX_COORD, MAX_DIMS, BadShape, BranchNotFound, CompactionConfig, CorruptBlock, DuplicateBranch, DuplicateSpace, PointSchema, Query, RetentionPolicy, SpaceConfig, SpaceNotFound, coord_columns,
)
from gridlore.operators.blocks import apply_retention
from gridlore.operators.join import safe_to_delete
from gridlore.operators.order import number_rows
from gridlore.operators.scan import latest, scan_faithful, scan_live, scan_versions
from gridlore.plans.compile import select_space
from gridlore.storage import cut

SPACES = "id long, name string, dims int"
BRANCHES = "id long, name string, head long, parent long, forked_at long"
#: One row a block that a snapshot adds or drops. ``sealed`` is the highest revision that the snapshot took from the log.
CHANGES = "snapshot_id long, space long, revision long, sealed long, parent long, dropped boolean, block_id long, hkey_min long, hkey_max long, min_revision long, max_revision long, n_rows long, checksum string, path string"
BLOCK_FIELDS = ["block_id", "hkey_min", "hkey_max", "min_revision", "max_revision", "n_rows", "checksum", "path"]
ROWS_PER_FILE = 4_000_000


class GridStore:
    """Spaces of versions; every read is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, root: str, on_write: Callable[[int, DataFrame], None] | None = None):
        """``on_write`` is given the space and the versions of every write, such as to enqueue them for replication."""
        self.spark, self.root, self.on_write = spark, root.rstrip("/"), on_write
        if self._read("branches", BRANCHES).isEmpty():
            self._write("branches", BRANCHES, [(1, "main", None, None, 0)])

    # -- catalogs

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.root}/meta/{name}")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if fs.exists(path(s.getPath(), "_SUCCESS")))

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/meta/{name}/{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def _read_all(self, name: str, schema: str) -> DataFrame:
        """All versions of a catalog that is written as changes."""
        found = self._versions(name)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/meta/{name}/{v}" for v in found]) if found else self.spark.createDataFrame([], schema)

    def _write(self, name: str, schema: str, rows: list | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        number = (self._versions(name) or [0])[-1] + 1
        df.coalesce(1).write.parquet(f"{self.root}/meta/{name}/{number}")

    def register_space(self, config: SpaceConfig) -> None:
        """Adds a space; a used id is reported before a used name."""
        rows = [tuple(r) for r in self._read("spaces", SPACES).collect()]
        if any(r[0] == config.id for r in rows):
            raise DuplicateSpace(f"space {config.id} exists")
        if any(r[1] == config.name for r in rows):
            raise DuplicateSpace(f"a space named {config.name!r} exists")
        self._write("spaces", SPACES, [*rows, (config.id, config.name, config.dims)])

    def spaces(self) -> DataFrame:
        return self._read("spaces", SPACES)

    def space(self, key: int | str) -> SpaceConfig:
        found = self.spaces().where(F.col("name" if isinstance(key, str) else "id") == key).first()
        if found is None:
            raise SpaceNotFound(str(key))
        return SpaceConfig(*found)

    def remove_space(self, space: int) -> SpaceConfig:
        old = self.space(space)
        self._write("spaces", SPACES, [tuple(r) for r in self.spaces().where(F.col("id") != space).collect()])
        return old

    # -- writes

    def _paths(self, kind: str, space: int) -> str:
        return f"{self.root}/{kind}/space={space}"

    def _exists(self, path: str) -> bool:
        fs, hadoop = self._fs()
        return fs.exists(hadoop(path)) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(hadoop(path)))

    def revision(self) -> int:
        """The highest revision written, from the manifest and the logs; it survives a crash."""
        top = self._read_all("manifest", CHANGES).agg(F.max(F.greatest("max_revision", "sealed"))).first()[0] or 0
        for (space,) in self.spaces().select("id").collect():
            if self._exists(self._paths("log", space)):
                top = max(top, self.spark.read.parquet(self._paths("log", space)).agg(F.max("revision")).first()[0] or 0)
        return top

    def insert(self, space: int, rows: DataFrame, order: list[str] | None = None, *, tombstone: bool = False, schema: PointSchema | None = None) -> int:
        """Appends a version a row and returns the last revision; ``rows`` has c0.. and payload columns.

        Revisions follow ``order`` (default: the coordinates, then the payload). ``schema`` projects other rows
        to coordinates and payload.
        """
        config = self.space(space)
        if schema is not None:
            rows = schema.project(rows)
        coords = coord_columns(config.dims)
        if missing := [c for c in coords if c not in rows.columns]:
            raise BadShape(f"rows of space {space} lack {missing}")
        checked = rows
        for c in coords:
            value = F.col(c).cast("long")
            checked = checked.withColumn(c, F.when(value.between(0, MAX_COORD), value).otherwise(F.raise_error(F.lit(f"{c} is no unsigned 32-bit coordinate"))))
        payload = [c for c in rows.columns if c not in coords]
        plain = [c for c in payload if not isinstance(rows.schema[c].dataType, (T.MapType,))]
        start = self.revision() + 1
        numbered = number_rows(checked, order or [*coords, *plain], "revision", start)
        cells = [F.shiftright(F.col(c), 32 - self._key_bits(config.dims)) for c in coords]
        shaped = numbered.withColumns({"tombstone": F.lit(tombstone), "hkey": hilbert_key(cells, self._key_bits(config.dims))})
        shaped.select(*coords, "revision", "tombstone", "hkey", *payload).write.mode("append").parquet(self._paths("log", space))
        last = self.spark.read.parquet(self._paths("log", space)).agg(F.max("revision")).first()[0]
        if self.on_write is not None and last is not None and last >= start:
            self.on_write(space, self.buffer(space).where(F.col("revision") >= start).select(*coords, "revision", "tombstone", *payload))
        return max(last or 0, start - 1)

    def delete(self, space: int, points: DataFrame) -> int:
        """Appends a tombstone for each point."""
        return self.insert(space, points.select(*coord_columns(self.space(space).dims)), tombstone=True)

    @staticmethod
    def _key_bits(dims: int) -> int:
        """Bits a coordinate of the clustering key, taken from the top: the key fits a bigint."""
        return max(1, min(16, 62 // dims)) if dims <= MAX_DIMS else 1

    def flush(self, space: int, rows_per_block: int = ROWS_PER_FILE) -> int | None:
        """Seals the buffer: versions sorted by (key, revision) into files by key range, and a new snapshot.

        The snapshot says up to which revision it took the log, and a buffer shows only what is above, so a
        crash before the log is deleted neither loses nor doubles a version.
        """
        buffer = self.buffer(space)
        if buffer is None:
            return None
        snapshot = self._seal(space, buffer, rows_per_block, keep=True)
        fs, hadoop = self._fs()
        fs.delete(hadoop(self._paths("log", space)), True)
        return snapshot

    def _seal(self, space: int, rows: DataFrame, rows_per_block: int, *, keep: bool, next_block: Callable[[], int] | None = None) -> int:
        """Writes blocks and the snapshot that adds them; it drops its parent's blocks unless they are kept."""
        known = self._read_all("manifest", CHANGES)
        of_space = F.col("space") == space
        snapshot, block, parent, sealed = known.agg(F.max("snapshot_id"), F.max("block_id"), F.max(F.when(of_space, F.col("snapshot_id"))), F.max(F.when(of_space, F.col("sealed")))).first()
        snapshot = (snapshot or 0) + 1
        path = f"{self._paths('blocks', space)}/flush={snapshot}"
        n, newest = rows.agg(F.count("*"), F.max("revision")).first()
        parts = max(1, -(-n // rows_per_block))
        rows.repartitionByRange(parts, "hkey", "revision").sortWithinPartitions("hkey", "revision").write.mode("overwrite").parquet(path)
        written = self.spark.read.parquet(path).withColumn("path", F.input_file_name())
        stats = written.groupBy("path").agg(
            F.min("hkey").alias("hkey_min"), F.max("hkey").alias("hkey_max"), F.min("revision").alias("min_revision"), F.max("revision").alias("max_revision"),
            F.count("*").alias("n_rows"), self._checksum(written).alias("checksum"),
        )
        found = [r.asDict() for r in stats.orderBy("hkey_min", "path").collect()]  # one row a file
        ids = iter(next_block, object()) if next_block else itertools.count((block or 0) + 1)
        sealed = max(sealed or 0, newest) if keep else sealed
        head = (snapshot, space, max(x["max_revision"] for x in found), sealed, parent)
        changes = self.spark.createDataFrame([(*head, False, next(ids), *(x[c] for c in BLOCK_FIELDS[1:])) for x in found], CHANGES)
        if not keep and parent is not None:
            old = self.manifest(space, parent)
            marks = dict(zip(("snapshot_id", "space", "revision", "sealed", "parent"), head))
            gone = old.select(*[F.lit(v).cast("long").alias(k) for k, v in marks.items()], F.lit(True).alias("dropped"), *BLOCK_FIELDS)
            changes = changes.unionByName(gone)
        self._write("manifest", CHANGES, cut(changes))
        return snapshot

    @staticmethod
    def _checksum(rows: DataFrame):
        """Digest of a set of rows in any order: the sum of their hashes, as columns of fixed order give them."""
        fields = [c for c in sorted(rows.columns) if c != "path" and not isinstance(rows.schema[c].dataType, T.MapType)]
        return F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).cast("string")

    # -- reads

    def buffer(self, space: int) -> DataFrame | None:
        """The versions of the log that no snapshot has taken."""
        path = self._paths("log", space)
        if not self._exists(path):
            return None
        sealed = self._read_all("manifest", CHANGES).where(F.col("space") == space).agg(F.max("sealed")).first()[0] or 0
        left = self.spark.read.option("mergeSchema", True).parquet(path).where(F.col("revision") > sealed)
        return None if sealed and left.isEmpty() else left

    def manifest(self, space: int, snapshot: int | None = None) -> DataFrame:
        """The blocks of a snapshot, the current one unless it is named: what was added up to it and not dropped."""
        all_ = self._read_all("manifest", CHANGES).where(F.col("space") == space)
        at = snapshot if snapshot is not None else self.current_snapshot(space)
        head = all_.where(F.col("snapshot_id") == F.lit(at)).limit(1).select(F.col("snapshot_id").alias("s"), F.col("revision").alias("r"), F.col("parent").alias("p"))
        upto = all_.where(F.col("snapshot_id") <= F.lit(at))
        live = upto.where("NOT dropped").join(upto.where("dropped").select("block_id"), "block_id", "left_anti")
        return live.crossJoin(F.broadcast(head)).select(F.col("s").alias("snapshot_id"), "space", F.col("r").alias("revision"), F.col("p").alias("parent"), *BLOCK_FIELDS)  # head is one row

    def has_block(self, space: int, block: int) -> bool:
        return not self.manifest(space).where(F.col("block_id") == block).isEmpty()

    def current_snapshot(self, space: int) -> int | None:
        return self._read_all("manifest", CHANGES).where(F.col("space") == space).agg(F.max("snapshot_id")).first()[0]

    def sealed(self, space: int, snapshot: int | None = None, as_of: int | None = None, ranges: list[tuple[int, int]] | None = None, *, verify: bool = False) -> DataFrame | None:
        """Versions of a snapshot's blocks. Blocks wholly above ``as_of`` or outside all key ``ranges`` are not opened;
        ``verify`` compares those that are with their checksums first."""
        at = snapshot if snapshot is not None else self.current_snapshot(space)
        if at is None:
            return None
        listed = self.manifest(space, at)
        if as_of is not None:
            listed = listed.where(F.col("min_revision") <= as_of)
        if ranges is not None:
            near = F.lit(False)
            for low, high in ranges:
                near = near | ((F.col("hkey_min") <= high) & (F.col("hkey_max") >= low))
            listed = listed.where(near)
        found = {r["path"]: r["checksum"] for r in listed.select("path", "checksum").collect()}
        if verify:
            self._verify(found)
        return self.spark.read.option("mergeSchema", True).parquet(*found) if found else None

    def _verify(self, files: dict[str, str]) -> None:
        folders: dict[str, list[str]] = {}
        for path in files:
            folders.setdefault(path.rsplit("/", 1)[0], []).append(path)
        for paths in folders.values():  # files of one seal have the same columns
            rows = self.spark.read.parquet(*paths).withColumn("path", F.input_file_name())
            for path, checksum in rows.groupBy("path").agg(self._checksum(rows)).collect():
                if files.get(path) != checksum:
                    raise CorruptBlock(path)

    def versions(self, space: int, snapshot: int | None = None, as_of: int | None = None, ranges: list[tuple[int, int]] | None = None, *, verify: bool = False) -> DataFrame:
        """Sealed versions, and buffered ones unless a snapshot is asked for, with their state."""
        parts = [(self.sealed(space, snapshot, as_of, ranges, verify=verify), "sealed")] + ([(self.buffer(space), "buffered")] if snapshot is None else [])
        found = [df.withColumns({"space": F.lit(space).cast("long"), "state": F.lit(s)}) for df, s in parts if df is not None]
        if not found:
            coords = "".join(f"{c} long, " for c in coord_columns(self.space(space).dims))
            return self.spark.createDataFrame([], coords + "revision long, tombstone boolean, hkey long, space long, state string")
        return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)

    def key_ranges(self, query: Query, dims: int) -> list[tuple[int, int]] | None:
        """A superset of the clustering keys of a query's box, where one is worth its while."""
        if not query.box or dims > 3 or len(query.box.low) != dims:
            return None
        bits = self._key_bits(dims)
        low, high = (tuple(min(max(c, 0), MAX_COORD) >> (32 - bits) for c in corner) for corner in (query.box.low, query.box.high))
        span = max(b - a for a, b in zip(low, high))
        return covering_ranges(low, high, bits, 8) if 0 <= span <= 256 else None

    def read(self, query: Query, *, mode: str = "live", verify: bool = False) -> DataFrame:
        """``live``: current state; ``versions``: every version; ``faithful``: as a buffer over blocks shows.

        A box opens only blocks whose keys may lie in it, and within them, rows are skipped by key.
        """
        dims = self.space(query.space).dims
        ranges = self.key_ranges(query, dims)
        rows = select_space(self.versions(query.space, query.snapshot, query.as_of, ranges, verify=verify), query, dims)
        if ranges is not None:
            near = F.lit(False)
            for a, b in ranges:
                near = near | F.col("hkey").between(a, b)
            rows = rows.where(near)
        key = coord_columns(dims)
        if mode == "versions":
            return scan_versions(rows, query.as_of, query.tombstones)
        if mode == "faithful":
            return scan_faithful(rows, key, "state", query.as_of)
        return scan_live(rows, key, query.as_of, query.tombstones)

    # -- maintenance

    def compact(self, space: int, config: CompactionConfig = CompactionConfig(), policy: RetentionPolicy = RetentionPolicy(), next_block: Callable[[], int] | None = None) -> int | None:
        """Rewrites the sealed versions of a space into fresh blocks under a new snapshot; older snapshots stay
        readable until ``vacuum``. Where nothing would be left, the snapshot stays as it is. ``next_block`` may
        number the blocks."""
        df = self.sealed(space)
        if df is None:
            return None
        key = coord_columns(self.space(space).dims)
        kept = df if config.retain_history else latest(df, key)
        kept = cut(apply_retention(kept, policy, key))
        if kept.isEmpty():
            return self.current_snapshot(space)
        return self._seal(space, kept, config.max_records_per_block, keep=False, next_block=next_block)

    def vacuum(self, space: int, keep: list[int] | None = None) -> int:
        """Deletes the files of blocks that none of the snapshots ``keep`` (default: the current one) lists; returns how many."""
        kept = keep if keep is not None else [x for x in [self.current_snapshot(space)] if x is not None]
        if not kept:
            return 0
        listed = self.manifest(space, kept[0])
        for snapshot in kept[1:]:
            listed = listed.unionByName(self.manifest(space, snapshot))
        every = self._read_all("manifest", CHANGES).where((F.col("space") == space) & ~F.col("dropped"))
        fs, hadoop = self._fs()
        return sum(fs.delete(hadoop(r["path"]), False) for r in safe_to_delete(every, listed).select("path").distinct().collect())  # one row a file

    # -- branches

    def create_branch(self, name: str, parent: str = "main", space: int | None = None) -> int:
        rows = [tuple(r) for r in self._read("branches", BRANCHES).collect()]
        if any(r[1] == name for r in rows):
            raise DuplicateBranch(name)
        base = next((r for r in rows if r[1] == parent), None)
        if base is None:
            raise BranchNotFound(parent)
        new = max(r[0] for r in rows) + 1
        head = base[2] if space is None else self.current_snapshot(space)
        self._write("branches", BRANCHES, [*rows, (new, name, head, base[0], self.revision())])
        return new

    def branch(self, key: int | str):
        found = self._read("branches", BRANCHES).where(F.col("name" if isinstance(key, str) else "id") == key).first()
        if found is None:
            raise BranchNotFound(str(key))
        return found

    def advance_branch(self, key: int | str, head: int) -> None:
        which = self.branch(key)["id"]
        rows = [tuple(r) for r in self._read("branches", BRANCHES).collect()]
        self._write("branches", BRANCHES, [(i, n, head if i == which else h, p, f) for i, n, h, p, f in rows])

    def branches(self) -> DataFrame:
        return self._read("branches", BRANCHES)
