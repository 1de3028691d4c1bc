"""Joins of point data: boxes, as-of, prefixes, and the anti-joins of block bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Grid levels are powers of two of the cell width, up to 32-bit coordinates.
LEVELS = 33


def range_join(points: DataFrame, boxes: DataFrame, axes: list[tuple[str, str, str]]) -> DataFrame:
    """Inner join of points with the boxes that hold them: axes are (point column, low column, high column).

    A hierarchical grid turns it into an equi-join: a box lives at the level whose cells are at least as
    wide as its widest side, so it touches at most two cells an axis; a point looks in its one cell of each
    level in use. The exact test follows. No all-against-all comparison at any size.
    """
    extent = F.greatest(*[F.col(hi) - F.col(lo) for _, lo, hi in axes], F.lit(0))
    # level: the least l with 2^l > extent
    level = F.when(extent > 0, F.floor(F.log2(extent.cast("double"))) + 1).otherwise(0).cast("int")
    valid = boxes.where(" AND ".join(f"`{lo}` <= `{hi}`" for _, lo, hi in axes)).withColumn("__level", level)
    used = sorted(r[0] for r in valid.select("__level").distinct().collect())  # at most LEVELS values
    shift = lambda c, lv: F.call_function("shiftright", F.col(c).cast("long"), lv)
    cells = valid
    names = []
    for k, (_, lo, hi) in enumerate(axes):
        names.append(f"__cell{k}")
        cells = cells.withColumn(f"__cell{k}", F.explode(F.sequence(shift(lo, F.col("__level")), shift(hi, F.col("__level")))))
    if not used:
        used = [0]
    probes = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in used])))
    for k, (p, _, _) in enumerate(axes):
        probes = probes.withColumn(f"__cell{k}", shift(p, F.col("__level")))
    met = probes.join(cells, ["__level", *names])
    for p, lo, hi in axes:
        met = met.where(F.col(p).between(F.col(lo), F.col(hi)))
    return met.drop("__level", *names)


def asof_join(probes: DataFrame, versions: DataFrame, key: list[str], *, at: str, revision: str = "revision", payload: list[str]) -> DataFrame:
    """Each probe with the latest version of its key at or before ``at``; payload null where there is none.

    Probes and versions merge into one ordered run by key and the last version is carried forward: one
    shuffle and one sort, where a range join would meet every earlier version.
    """
    left = probes.withColumns({"__at": F.col(at), "__probe": F.lit(1)}).withColumn("__v", F.lit(None).cast(versions.select(F.struct(revision, *payload).alias("v")).schema[0].dataType))
    extra = [c for c in probes.columns if c not in key]
    right = versions.select(*key, *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra], F.col(revision).alias("__at"), F.lit(0).alias("__probe"), F.struct(revision, *payload).alias("__v"))
    w = Window.partitionBy(*key).orderBy("__at", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.select(*right.columns).unionByName(right).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return carried.where("__probe = 1").select(*probes.columns, *[F.col(f"__v.{c}").alias(f"version_{c}") for c in [revision, *payload]])


def parent_join(parents: DataFrame, children: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of a nested space with the parent whose address is their prefix."""
    on = None
    for p, c in pairs:
        test = parents[p] == children[c]
        on = test if on is None else on & test
    return parents.join(children, on)


def missing_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks of ``a`` that ``b`` does not list."""
    return a.join(b.select("block_id").distinct(), "block_id", "left_anti")


def delta(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed): blocks to give to the target's holder, and ids it should drop."""
    return missing_blocks(source, target), missing_blocks(target, source).select("block_id")


def delta_is_empty(added: DataFrame, removed: DataFrame) -> bool:
    """Whether nothing is to be given and nothing to be dropped."""
    return added.isEmpty() and removed.isEmpty()


def apply_delta(current: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(current - removed) + added; an added block replaces one of the same id."""
    gone = removed.select("block_id").union(added.select("block_id")).distinct()
    return current.join(gone, "block_id", "left_anti").unionByName(added)


def safe_to_delete(superseded: DataFrame, referenced: DataFrame) -> DataFrame:
    """Superseded blocks that no snapshot lists."""
    return missing_blocks(superseded, referenced)
