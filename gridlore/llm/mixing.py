"""Mixing sources to target token weights by entropy balancing.

Every document gets a rate (expected number of copies). Among all rates that give each source its target
of tokens, entropy balancing takes those closest to one copy each in relative entropy, under the ceiling
``max_rate``: ``rate = min(max_rate, exp(lambda_s * size / mean_s))``. The multipliers solve the convex
dual; it is separable by source, and Newton's method with a bracket solves all sources at once, each
iteration one aggregation over the table of (source, size, number of documents), which is exact and far
smaller than the corpus. Rates become whole copies by systematic rounding along sizes, and what remains of
a source's target is settled on its small documents. Which documents of a cell get the extra copies is decided
by one threshold on a hash, so the documents themselves are not sorted or moved.

Sums of floating point terms are taken as integers of 2^-10 tokens, so reruns agree in any task order.
Native DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import carried, cut, n_words, seeded

#: Documents of one source and size are told apart in this many parts, so that a large group of copies is split.
PARTS = 64
#: Most (source, size) cells that are broadcast (about 60 bytes each); more are joined by shuffle, by cell and part.
MAX_BROADCAST_CELLS = 300_000
SCALE = 1024.0
MAX_ITERATIONS = 60
TOLERANCE = 1e-7
LN = math.log


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets by source from (source, total): water-filling of ``share`` times all tokens by weight.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``cap`` times its
    source's tokens; the excess goes to the others by weight until none is above. The saturated sources
    are a prefix in the order of cap over weight, so two running sums give the common level directly.
    The windows run over sources, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    w = ranked.withColumns({"weight": weight, "most": cap * F.col("total"), "all": share * F.sum("total").over(Window.partitionBy())})
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = w.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())  # the first unsaturated one's
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * common)
    return leveled.select("source", F.col("total").alias("source_size"), target.alias("target"), F.col("full").alias("full"))


def _whole(term):
    return F.sum(F.round(term * SCALE).cast("long"))


def solve_dual(cells: DataFrame, targets: DataFrame, max_rate: float) -> DataFrame:
    """(skey, lam, mean, ...): the multiplier of every source, by safeguarded Newton iterations.

    ``cells`` has (skey, size, n); ``targets`` (skey, source_size, target, full). Sources at the ceiling
    need no multiplier (null: rate ``max_rate``). The state of an iteration is one row a source.
    """
    mean = F.col("source_size") / F.col("docs")
    docs = cells.groupBy("skey").agg(F.sum("n").alias("docs"))
    null = F.lit(None).cast("double")
    done = F.col("full") | (F.col("source_size") == 0)
    state = cut(
        targets.join(docs, "skey").select(
            "skey", "target", "source_size", "full", mean.alias("mean"),
            F.when(~done, F.log(F.col("target") / F.col("source_size"))).alias("lam"), null.alias("lo"), null.alias("hi"), done.alias("done"),
        )
    )
    z = F.col("size") / F.col("mean")
    tilt = F.exp(F.least(F.col("lam") * z, F.lit(LN(max_rate))))
    mass = F.col("n") * F.col("size") * tilt
    for _ in range(MAX_ITERATIONS):
        if state.where(~F.col("done")).isEmpty():
            return state
        sums = (
            cells.where("size > 0").join(state.where(~F.col("done")).select("skey", "lam", "mean"), "skey")
            .groupBy("skey")
            .agg((_whole(mass) / SCALE).alias("g"), (_whole(F.when(F.col("lam") * z < LN(max_rate), mass * z).otherwise(0.0)) / SCALE).alias("slope"))
        )
        gap = F.col("g") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.coalesce(lo, newton - 1)) & (newton < F.coalesce(hi, newton + 1)) & (F.abs(newton - F.col("lam")) < 4 + F.abs(F.col("lam")))
        out = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(gap < 0, F.col("lam") + 2 + F.abs("lam")).otherwise(F.col("lam") - 2 - F.abs("lam"))
        over = F.coalesce(F.abs(gap) <= TOLERANCE * F.col("target") + 1, F.lit(True))
        stuck = F.coalesce((hi - lo) < 1e-13 * (1 + F.abs(hi)), F.lit(False))
        stepped = state.join(sums, "skey", "left").withColumns({"nlo": lo, "nhi": hi, "over": F.col("done") | over | stuck})
        state = cut(
            stepped.select(
                "skey", "target", "source_size", "full", "mean",
                F.when(F.col("over"), F.col("lam")).when(inside, newton).otherwise(out).alias("lam"),
                F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), F.col("over").alias("done"),
            )
        )
    raise RuntimeError(f"the dual did not settle in {MAX_ITERATIONS} iterations")


#: What mix() adds.
MADE = ["size", "source_size", "target", "rate", "copies", "taken"]


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", key: list[str], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_rate: float = 2.0, seed: int = 11, size_col: str | None = None, stable: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` plus size, source_size, target, rate, copies and taken (copies times size).

    Null texts and texts without a word have size 0, rate 1 and one copy, which takes nothing. A null source
    is a source of its own. Every source's taken tokens end within a small document of its target; no row
    gets more than ``max_rate`` copies. Repeated rows are separate rows. An empty table gives an empty
    result. Columns named like one of the six are replaced, any other name is kept.

    ``key`` columns order the rows of one source and size by a hash, ties by their place in the input.
    ``size_col`` names a column of sizes already counted. ``stable`` says that rows keep their places when
    a task is run again (files or a checkpoint, no shuffle after them); else they are checkpointed first.
    """
    inner, back = carried(docs, docs.columns, MADE)
    size = F.col(size_col) if size_col else n_words(docs[text_col])
    skey = F.coalesce(F.concat(F.lit("s"), docs[source_col]), F.lit("n"))
    h = seeded(seed, *[docs[c] for c in key])
    rows = docs.select(*inner, size.alias("w"), skey.alias("skey"), seeded(seed + 1, h).alias("h"))
    rows = (rows if stable else cut(rows)).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int"))
    # the texts are read once for the statistics; what these need of a row is small
    narrow = cut(rows.select("skey", "w", "part", "h", "at"))
    parts = cut(narrow.groupBy("skey", F.col("w").alias("size"), "part").agg(F.count("*").alias("m")))
    cells = cut(parts.groupBy("skey", "size").agg(F.sum("m").alias("n")))
    totals = cells.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("total")).withColumn("source", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)))
    targets = cut(source_targets(totals, weights, share, max_rate).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    state = solve_dual(cells, targets.drop("source"), max_rate)

    lam_z = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("full"), F.lit(float(max_rate))).otherwise(F.exp(F.least(lam_z, F.lit(LN(max_rate)))))
    down = Window.partitionBy("skey").orderBy(F.col("size").desc())
    up = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    expected = cells.join(state, "skey").withColumn("rate", rate).withColumn("e", F.col("n") * F.col("rate"))
    running = F.sum("e").over(down)
    most = (F.col("n") * max_rate).cast("long")
    first = expected.withColumn("k", F.least(most, F.greatest(F.lit(0).cast("long"), F.floor(running + 0.5) - F.floor(running - F.col("e") + 0.5))))
    gap = F.round(F.col("target")).cast("long") - F.sum(F.col("k") * F.col("size")).over(Window.partitionBy("skey"))
    spare = F.when(F.col("size") == 0, 0).when(F.col("gap") > 0, most - F.col("k")).otherwise(F.col("k"))
    settled = first.withColumn("gap", gap).withColumn("spare", spare.cast("long")).withColumn("before", F.coalesce(F.sum(F.col("spare") * F.col("size")).over(up), F.lit(0).cast("long")))
    fix = F.when((F.col("size") > 0) & (F.col("before") < F.abs("gap")), F.least(F.col("spare"), F.floor((F.abs("gap") - F.col("before")) / F.greatest(F.col("size"), F.lit(1))).cast("long"))).otherwise(0)
    whole = settled.withColumn("k", F.col("k") + F.signum(F.col("gap").cast("double")).cast("long") * fix)
    by_cell = cut(whole.select("skey", "size", "source_size", "target", "rate", F.floor(F.col("k") / F.col("n")).alias("base"), (F.col("k") % F.col("n")).alias("extra")))
    # extra copies go to whole parts of a cell in turn; within the part where they end, to its first rows by (h, at)
    in_cell = Window.partitionBy("skey", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    prior = parts.withColumn("prior", F.coalesce(F.sum("m").over(in_cell), F.lit(0).cast("long"))).join(by_cell.select("skey", "size", "extra"), ["skey", "size"])
    ends = prior.where((F.col("prior") < F.col("extra")) & (F.col("extra") <= F.col("prior") + F.col("m"))).select("skey", F.col("size").alias("w"), "part", (F.col("extra") - F.col("prior")).alias("here"))
    rank = F.row_number().over(Window.partitionBy("skey", "w", "part").orderBy("h", "at"))
    last = narrow.join(ends, ["skey", "w", "part"]).withColumn("rank", rank).where(F.col("rank") == F.col("here")).select("skey", F.col("w").alias("size"), F.struct("part", "h", "at").alias("last"))
    plan = cut(by_cell.drop("extra").join(last, ["skey", "size"], "left").withColumnRenamed("size", "w"))
    on = ["skey", "w"]
    if plan.limit(MAX_BROADCAST_CELLS + 1).count() <= MAX_BROADCAST_CELLS:
        plan = F.broadcast(plan)
    else:
        plan, on = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "part"]
    copies = (F.col("base") + F.coalesce(F.struct("part", "h", "at") <= F.col("last"), F.lit(False)).cast("long")).cast("long")
    planned = rows.join(plan, on).withColumn("copies", copies)
    return planned.select(*back, F.col("w").alias("size"), "source_size", "target", "rate", "copies", (F.col("copies") * F.col("w")).alias("taken"))
