"""The library's queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore.functions import clock, ordinal
from gridlore.functions.hilbert import CompositeKey, covering_ranges, hilbert_key, hilbert_point, key_of, quantize
from gridlore.model import CompactionConfig, RetentionPolicy
from gridlore.model import Query as ReadQuery
from gridlore.operators import blocks, join, merkle, order, outbox, scan, sync
from gridlore.sources.bindings import BLOCK, EV_KEY, LI_KEY, PT_KEY, event_state, events, lineitems, nested, parts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS c0, CAST(hour(ts) AS BIGINT) AS c1, event_id + 1 AS revision, event_type = 'error' AS tombstone, event_type, value, event_id // 256 AS block_id FROM events)"
STATE = EV + ", st AS (SELECT *, CASE WHEN revision <= floor(0.8 * (SELECT max(revision) FROM ev)) THEN 'sealed' ELSE 'buffered' END AS state FROM ev)"
SHOWN = ["c0", "c1", "revision", "event_type", "value"]
SHOWN_SQL = ", ".join(SHOWN)
LIVE = "SELECT *, row_number() OVER (PARTITION BY c0, c1 ORDER BY revision DESC) AS rn FROM ev"
#: Hundredths of the largest revision: of as-of reads, and of a fork.
AS_OF_SHARE, FORKED = 70, 30
AS_OF = f"(SELECT {AS_OF_SHARE} * max(revision) // 100 FROM ev)"


def _revision_at(versions: DataFrame, share: int = AS_OF_SHARE) -> int:
    """The revision at so many hundredths of the largest one."""
    return share * (versions.agg(F.max("revision")).first()[0] or 0) // 100


def query(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- scans

@query("scan_versions_asof", f"WITH {EV} SELECT {SHOWN_SQL} FROM ev WHERE revision <= {AS_OF} AND NOT tombstone")
def scan_versions_asof(spark, sf):
    return scan.scan_versions(events(spark, sf), _revision_at(events(spark, sf))).select(*SHOWN)


@query("scan_live_latest", f"WITH {EV}, l AS ({LIVE}) SELECT {SHOWN_SQL} FROM l WHERE rn = 1 AND NOT tombstone")
def scan_live_latest(spark, sf):
    return scan.scan_live(events(spark, sf), EV_KEY).select(*SHOWN)


@query("scan_live_asof", f"WITH {EV}, l AS ({LIVE} WHERE revision <= {AS_OF}) SELECT {SHOWN_SQL} FROM l WHERE rn = 1 AND NOT tombstone")
def scan_live_asof(spark, sf):
    return scan.scan_live(events(spark, sf), EV_KEY, _revision_at(events(spark, sf))).select(*SHOWN)


@query("scan_include_tombstones", f"WITH {EV} SELECT {SHOWN_SQL}, tombstone FROM ev WHERE revision <= {AS_OF}")
def scan_include_tombstones(spark, sf):
    return scan.scan_versions(events(spark, sf), _revision_at(events(spark, sf)), tombstones=True).select(*SHOWN, "tombstone")


@query("scan_live_with_tombstones", f"WITH {EV}, l AS ({LIVE}) SELECT {SHOWN_SQL}, tombstone FROM l WHERE rn = 1")
def scan_live_with_tombstones(spark, sf):
    return scan.scan_live(events(spark, sf), EV_KEY, tombstones=True).select(*SHOWN, "tombstone")


@query("scan_buffered_antijoin", f"WITH {EV} SELECT {SHOWN_SQL} FROM ev e WHERE NOT tombstone AND revision <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM ev t WHERE t.tombstone AND t.revision <= {AS_OF} AND t.c0 = e.c0 AND t.c1 = e.c1)")
def scan_buffered_antijoin(spark, sf):
    return scan.scan_buffered(events(spark, sf), EV_KEY, _revision_at(events(spark, sf))).select(*SHOWN)


@query("scan_faithful_sealed_buffer", f"WITH {STATE} SELECT {SHOWN_SQL} FROM st e WHERE NOT tombstone AND NOT EXISTS (SELECT 1 FROM st t WHERE t.tombstone AND t.state = 'buffered' AND t.c0 = e.c0 AND t.c1 = e.c1)")
def scan_faithful_sealed_buffer(spark, sf):
    return scan.scan_faithful(event_state(spark, sf), EV_KEY, "state").select(*SHOWN)


@query("bbox_2d", f"WITH {EV} SELECT {SHOWN_SQL} FROM ev WHERE NOT tombstone AND c0 BETWEEN 2 AND 9 AND c1 BETWEEN 6 AND 18")
def bbox_2d(spark, sf):
    return scan.scan_versions(events(spark, sf).where(scan.within(EV_KEY, (2, 6), (9, 18)))).select(*SHOWN)


@query("bbox_3d", "SELECT l_partkey AS c0, l_suppkey AS c1, CAST(l_quantity AS BIGINT) AS c2, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line FROM lineitem WHERE l_partkey BETWEEN 20 AND 400 AND l_suppkey BETWEEN 2 AND 60 AND CAST(l_quantity AS BIGINT) BETWEEN 10 AND 30")
def bbox_3d(spark, sf):
    # the quantity's bounds also hold on the stored double, where they push to the scan
    li = table(spark, sf, "lineitem").where(F.col("l_quantity").between(10.0, 31.0))
    wide = li.select(F.col("l_partkey").alias("c0"), F.col("l_suppkey").alias("c1"), F.col("l_quantity").cast("long").alias("c2"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"))
    return wide.where(scan.within(LI_KEY, (20, 2, 10), (400, 60, 30)))


@query("bbox_asof_live", f"WITH {EV}, l AS ({LIVE} WHERE revision <= {AS_OF} AND c0 BETWEEN 0 AND 40 AND c1 BETWEEN 0 AND 11) SELECT {SHOWN_SQL} FROM l WHERE rn = 1 AND NOT tombstone")
def bbox_asof_live(spark, sf):
    return scan.scan_live(events(spark, sf).where(scan.within(EV_KEY, (0, 0), (40, 11))), EV_KEY, _revision_at(events(spark, sf))).select(*SHOWN)


@query("subscope_parent", "SELECT l_orderkey AS c0, CAST(l_linenumber AS BIGINT) AS c1, l_partkey AS part, l_quantity FROM lineitem WHERE l_orderkey = 3")
def subscope_parent(spark, sf):
    return nested(spark, sf).where(scan.prefixed(["c0", "c1"], (3,)))


@query("point_lookup", f"WITH {EV}, l AS (SELECT *, row_number() OVER (ORDER BY revision DESC) AS rn FROM ev WHERE c0 = 1 AND c1 = 9 AND revision <= 9000) SELECT {SHOWN_SQL} FROM l WHERE rn = 1 AND NOT tombstone")
def point_lookup(spark, sf):
    return scan.point_lookup(events(spark, sf), EV_KEY, (1, 9), 9000).select(*SHOWN)


@query("version_history_intervals", f"WITH {EV} SELECT c0, c1, revision, tombstone, lag(revision) OVER w AS previous, lead(revision) OVER w AS valid_to FROM ev WINDOW w AS (PARTITION BY c0, c1 ORDER BY revision)")
def version_history_intervals(spark, sf):
    return scan.history(events(spark, sf), EV_KEY).select("c0", "c1", "revision", "tombstone", "previous", "valid_to")


# ---- joins

BOXES = [(0, 0, 5, 8, 16), (1, 10, 20, 0, 5), (2, 12, 12, 3, 3), (3, 0, 1000000, 23, 23), (4, 7, 3, 0, 9)]
BOXES_SQL = "boxes(box, x0, x1, y0, y1) AS (VALUES " + ", ".join(map(str, BOXES)) + ")"


def values(spark, rows, names, types):
    return spark.sql("SELECT " + ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types)) + " FROM VALUES " + ", ".join(str(r).replace("None", "NULL") for r in rows) + " AS v(" + ", ".join(names) + ")")


@query("range_join_points_boxes", f"WITH {EV}, {BOXES_SQL} SELECT CAST(box AS BIGINT) AS box, c0, c1, revision FROM ev JOIN boxes ON c0 BETWEEN x0 AND x1 AND c1 BETWEEN y0 AND y1 WHERE NOT tombstone")
def range_join_points_boxes(spark, sf):
    boxes = values(spark, BOXES, ["box", "x0", "x1", "y0", "y1"], ["BIGINT"] * 5)
    points = scan.scan_versions(events(spark, sf)).select("c0", "c1", "revision")
    return join.range_join(points, boxes, [("c0", "x0", "x1"), ("c1", "y0", "y1")]).select("box", "c0", "c1", "revision")


@query("asof_join", f"WITH {EV}, p AS (SELECT DISTINCT c0, c1, r AS at FROM ev, (VALUES (100), (400), (900)) v(r)) SELECT p.c0, p.c1, CAST(p.at AS BIGINT) AS at, e.revision AS version_revision, e.tombstone AS version_tombstone, e.value AS version_value FROM p ASOF LEFT JOIN ev e ON p.c0 = e.c0 AND p.c1 = e.c1 AND p.at >= e.revision")
def asof_join(spark, sf):
    ev = events(spark, sf)
    probes = ev.select("c0", "c1").distinct().withColumn("at", F.explode(F.array(*[F.lit(x).cast("long") for x in (100, 400, 900)])))
    return join.asof_join(probes, ev, EV_KEY, at="at", payload=["tombstone", "value"])


@query("parent_equijoin", "SELECT o_orderkey AS order_key, o_orderstatus AS status, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def parent_equijoin(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"))
    return join.parent_join(orders, nested(spark, sf), [("order_key", "c0")]).select("order_key", "status", F.col("c1").alias("line"), "part")


# ---- curve keys

def _sql_hilbert(source: str, dims: int, bits: int, out: str) -> str:
    """The curve key by recursion over (bit, axis) steps; ``source`` has distinct points x0.. and ``out`` selects."""
    xs = [f"x{i}" for i in range(dims)]
    last = dims * (bits - 1)
    q, i = f"(1 << CAST({bits - 1} - k // {dims} AS INTEGER))", f"(k % {dims})"
    here = "CASE " + " ".join(f"WHEN {i} = {j} THEN x{j}" for j in range(dims)) + " END"
    hit = f"(({here}) & {q}) <> 0"
    swap = f"(xor(x0, {here}) & ({q} - 1))"
    x0 = f"CASE WHEN {hit} THEN xor(x0, {q} - 1) ELSE xor(x0, {swap}) END"
    rest = [f"CASE WHEN {i} = {j} AND NOT ({hit}) THEN xor(x{j}, {swap}) ELSE x{j} END" for j in range(1, dims)]
    steps = ", ".join(f"{e} AS {x}" for e, x in zip([x0, *rest], xs))
    g, acc = [], None
    for x in xs:
        acc = x if acc is None else f"xor({acc}, {x})"
        g.append(acc)
    t = "0"
    for s in range(1, bits):
        t = f"xor({t}, g{dims - 1} >> {s})"
    key = " | ".join(f"(((xor(g{a}, t) >> {b}) & 1) << {b * dims + dims - 1 - a})" for b in range(bits) for a in range(dims))
    orig = ", ".join(f"o{i}" for i in range(dims))
    return (
        f"WITH RECURSIVE src AS ({source}), h AS (SELECT {', '.join(f'x{j} AS o{j}' for j in range(dims))}, "
        + ", ".join(f"CAST(x{j} & {(1 << bits) - 1} AS BIGINT) AS x{j}" for j in range(dims))
        + f", 0 AS k FROM src UNION ALL SELECT {orig}, {steps}, k + 1 FROM h WHERE k < {last}), "
        f"gr AS (SELECT {orig}, {', '.join(f'{e} AS g{j}' for j, e in enumerate(g))} FROM h WHERE k = {last}), tt AS (SELECT *, {t} AS t FROM gr), "
        f"keyed AS (SELECT {orig}, CAST({key} AS BIGINT) AS hkey FROM tt) {out}"
    )


PT_POINTS = "SELECT DISTINCT CAST(p_size AS BIGINT) AS x0, CAST(substr(p_brand, 7) AS BIGINT) AS x1 FROM part"
LI_POINTS = "SELECT DISTINCT l_partkey AS x0, l_suppkey AS x1, CAST(l_quantity AS BIGINT) AS x2 FROM lineitem"
PT_KEYED = "SELECT o0 AS c0, o1 AS c1, hkey FROM keyed"


def _pt_keys(spark, sf):
    return parts(spark, sf).select("c0", "c1").distinct().withColumn("hkey", hilbert_key([F.col("c0"), F.col("c1")], 8))


@query("hilbert_encode_2d", _sql_hilbert(PT_POINTS, 2, 8, PT_KEYED))
def hilbert_encode_2d(spark, sf):
    return _pt_keys(spark, sf)


@query("hilbert_encode_3d", _sql_hilbert(LI_POINTS, 3, 8, "SELECT o0 AS c0, o1 AS c1, o2 AS c2, hkey FROM keyed"))
def hilbert_encode_3d(spark, sf):
    return _li_keys(lineitems(spark, sf))


def _li_keys(rows: DataFrame) -> DataFrame:
    return rows.select(*LI_KEY).distinct().withColumn("hkey", hilbert_key([F.col(c) for c in LI_KEY], 8))


@query("hilbert_decode_2d", _sql_hilbert(PT_POINTS, 2, 8, "SELECT hkey, o0 AS d0, o1 AS d1 FROM keyed"))
def hilbert_decode_2d(spark, sf):
    return _pt_keys(spark, sf).withColumn("d", hilbert_point(F.col("hkey"), 2, 8)).select("hkey", F.col("d")[0].alias("d0"), F.col("d")[1].alias("d1"))


@query("hilbert_key_range_scan", _sql_hilbert(PT_POINTS, 2, 8, PT_KEYED + " WHERE hkey BETWEEN 200 AND 900"))
def hilbert_key_range_scan(spark, sf):
    return _pt_keys(spark, sf).where(F.col("hkey").between(200, 900))


@query("hilbert_box_ranges", _sql_hilbert(PT_POINTS, 2, 8, PT_KEYED + " WHERE o0 BETWEEN 5 AND 20 AND o1 BETWEEN 11 AND 33"))
def hilbert_box_ranges(spark, sf):
    low, high = (5, 11), (20, 33)
    near = None
    for a, b in covering_ranges(low, high, 8, 16):
        test = F.col("hkey").between(a, b)
        near = test if near is None else near | test
    return _pt_keys(spark, sf).where(near).where(scan.within(PT_KEY, low, high))


@query("hilbert_sorted_rank", _sql_hilbert(PT_POINTS, 2, 8, "SELECT o0 AS c0, o1 AS c1, row_number() OVER (ORDER BY hkey) - 1 AS rank FROM keyed"))
def hilbert_sorted_rank(spark, sf):
    return order.number_rows(_pt_keys(spark, sf), ["hkey"], "rank").select("c0", "c1", "rank")


@query("composite_key_mixed", _sql_hilbert("SELECT DISTINCT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS x0, (CAST(user_id AS BIGINT) + 2147483648) >> 24 AS x1, CAST(hour(ts) AS BIGINT) AS x2 FROM events", 3, 8, "SELECT CAST(o0 AS BIGINT) AS kind, o1 AS user_coord, o2 AS hour, hkey FROM keyed"))
def composite_key_mixed(spark, sf):
    src = table(spark, sf, "events").select(
        ordinal.encode_enum(F.col("event_type"), EVENT_TYPES).alias("kind"), quantize(ordinal.encode_i32(F.col("user_id")), 8).alias("user_coord"), F.hour("ts").cast("long").alias("hour")
    ).distinct()
    key = CompositeKey(8).push("kind", F.col("kind")).push("user", F.col("user_coord")).push("hour", F.col("hour"))
    return src.withColumn("hkey", key.encode())


@query("hilbert_corner_keys", "SELECT 136 AS low_key, 41088 AS high_key")
def hilbert_corner_keys(spark, sf):
    return spark.range(1).select(F.lit(key_of((10, 10), 8)).alias("low_key"), F.lit(key_of((200, 200), 8)).alias("high_key"))


# ---- scalars

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("ordinal_i32", "SELECT c_custkey, CAST(CAST(c_nationkey AS BIGINT) - 12 + 2147483648 AS BIGINT) AS coord, CAST(c_nationkey - 12 AS INTEGER) AS decoded FROM customer")
def ordinal_i32(spark, sf):
    coord = ordinal.encode_i32(F.col("c_nationkey") - 12)
    return table(spark, sf, "customer").select("c_custkey", coord.alias("coord"), ordinal.decode_i32(coord).alias("decoded"))


@query("ordinal_f32", "WITH b AS (SELECT vec_id, embedding[1] AS x, CAST(CAST(embedding[1] AS FLOAT)::BIT AS BIGINT) AS raw FROM embeddings), u AS (SELECT *, CASE WHEN raw < 0 THEN raw + 4294967296 ELSE raw END AS bits FROM b) SELECT vec_id, CASE WHEN bits >= 2147483648 THEN 4294967295 - bits ELSE bits + 2147483648 END AS coord, CAST(x AS DOUBLE) AS decoded FROM u")
def ordinal_f32(spark, sf):
    first = table(spark, sf, "embeddings").select("vec_id", ordinal.encode_f32(F.col("embedding")[0]).alias("coord"))
    return first.withColumn("decoded", ordinal.decode_f32(F.col("coord")).cast("double"))


@query("ordinal_enum", "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS BIGINT) AS coord FROM events")
def ordinal_enum(spark, sf):
    return table(spark, sf, "events").select("event_id", ordinal.encode_enum(F.col("event_type"), EVENT_TYPES).alias("coord"))


@query("hlc_pack_unpack_coord", "WITH t AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, event_id % 7 AS l FROM events) SELECT event_id, (ms << 16) | l AS packed, ms AS physical_ms, CAST(l AS INTEGER) AS logical, ((ms << 16) | l) >> 32 AS coord FROM t")
def hlc_pack_unpack_coord(spark, sf):
    packed = clock.pack(F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 7)
    t = table(spark, sf, "events").select("event_id", packed.alias("packed"))
    return t.select("event_id", "packed", clock.physical(F.col("packed")).alias("physical_ms"), clock.logical(F.col("packed")).alias("logical"), clock.to_coord(F.col("packed")).alias("coord"))


HLC_SQL = "e AS (SELECT event_id, user_id AS node, (event_id * 37) % 50 + event_id // 4 AS now FROM events)"


@query("hlc_tick", f"WITH {HLC_SQL}, p AS (SELECT *, greatest(max(now) OVER (PARTITION BY node ORDER BY event_id), 0) AS physical_ms FROM e) SELECT event_id, node, physical_ms, CAST(least(row_number() OVER (PARTITION BY node, physical_ms ORDER BY event_id) - CASE WHEN physical_ms > 0 THEN 1 ELSE 0 END, 65535) AS INTEGER) AS logical FROM p")
def hlc_tick(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("node"), ((F.col("event_id") * 37) % 50 + F.floor(F.col("event_id") / 4)).alias("now"))
    return clock.tick_sequence(e, now="now", order=["event_id"], node=["node"]).drop("now")


RECEIVE = "SELECT event_id, user_id AS node, 1 + (event_id * 37) % 50 + event_id // 4 AS now, 1 + (event_id * 53) % 60 + event_id // 4 AS rp, event_id % 5 AS rl, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"


@query("hlc_receive", f"""WITH RECURSIVE e AS ({RECEIVE}), f AS (
  SELECT event_id, node, k, greatest(rp, now) AS p, CASE WHEN rp >= now THEN rl + 1 ELSE 0 END AS l FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_id, e.node, e.k, greatest(f.p, e.rp, e.now),
    CASE WHEN greatest(f.p, e.rp, e.now) = f.p AND f.p = e.rp THEN greatest(f.l, e.rl) + 1 WHEN greatest(f.p, e.rp, e.now) = f.p THEN f.l + 1
         WHEN greatest(f.p, e.rp, e.now) = e.rp THEN e.rl + 1 ELSE 0 END
  FROM f JOIN e ON e.node = f.node AND e.k = f.k + 1)
SELECT event_id, node, CAST(p AS BIGINT) AS physical_ms, CAST(l AS INTEGER) AS logical FROM f""")
def hlc_receive(spark, sf):
    i = F.col("event_id")
    e = table(spark, sf, "events").select(i, F.col("user_id").alias("node"), (1 + (i * 37) % 50 + F.floor(i / 4)).alias("now"), (1 + (i * 53) % 60 + F.floor(i / 4)).alias("rp"), (i % 5).alias("rl"))
    return clock.receive_sequence(e, remote_ms="rp", remote_logical="rl", now="now", order=["event_id"], node=["node"]).drop("now", "rp", "rl")


@query("outbox_backoff", "SELECT CAST(a AS INTEGER) AS attempts, CAST(least(1000 * (1 << CAST(least(a, 6) AS INTEGER)), 60000) AS BIGINT) AS delay_ms FROM range(1, 10) t(a)")
def outbox_backoff(spark, sf):
    return spark.range(1, 10).select(F.col("id").cast("int").alias("attempts"), outbox.backoff_ms(F.col("id")).alias("delay_ms"))


@query("format_bytes", "SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.2f MB', n / 1048576.0) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * 1000 AS BIGINT) AS n FROM orders)")
def format_bytes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", blocks.format_bytes((F.col("o_orderkey") * 1000).cast("long")).alias("size"))


# ---- numbering, log

@query("revision_assignment", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 5000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS revision FROM lineitem")
def revision_assignment(spark, sf):
    return _numbered(table(spark, sf, "lineitem"))


def _numbered(rows: DataFrame) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    return order.number_rows(rows.select(*keys), keys, "revision", 5001).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "revision")


WAL_SQL = EV + ", wal AS (SELECT revision AS pos, CASE WHEN revision % 100 = 0 THEN 'checkpoint' WHEN revision % 256 = 0 THEN 'block_sealed' WHEN tombstone THEN 'tombstone' ELSE 'write' END AS kind, c0, c1, revision, NOT (revision % 997 = 0 AND revision > 500) AS valid FROM ev), ok AS (SELECT * FROM wal WHERE pos < coalesce((SELECT min(pos) FROM wal WHERE NOT valid), 1 << 60))"


def _wal(spark, sf):
    r = F.col("revision")
    kind = F.when(r % 100 == 0, "checkpoint").when(r % 256 == 0, "block_sealed").when(F.col("tombstone"), "tombstone").otherwise("write")
    return events(spark, sf).select(r.alias("pos"), kind.alias("kind"), "c0", "c1", "revision", (~((r % 997 == 0) & (r > 500))).alias("valid"))


@query("wal_valid_prefix", f"WITH {WAL_SQL} SELECT pos, kind FROM ok")
def wal_valid_prefix(spark, sf):
    return order.latest_prefix(_wal(spark, sf), "pos", "valid").select("pos", "kind")


@query("wal_replay", f"WITH {WAL_SQL} SELECT c0, c1, revision, kind = 'tombstone' AS tombstone FROM ok WHERE kind IN ('write', 'tombstone')")
def wal_replay(spark, sf):
    log = order.latest_prefix(_wal(spark, sf), "pos", "valid").where(F.col("kind").isin("write", "tombstone"))
    return log.select("c0", "c1", "revision", (F.col("kind") == "tombstone").alias("tombstone"))


# ---- blocks, compaction, retention

STATS_SQL = "SELECT block_id, count(*) AS n_rows, min(revision) AS min_revision, max(revision) AS max_revision"


@query("block_stats", f"WITH {EV} {STATS_SQL}, min(c0) AS min_c0, max(c0) AS max_c0 FROM ev GROUP BY block_id")
def block_stats(spark, sf):
    return blocks.block_stats(events(spark, sf), [F.min("c0").alias("min_c0"), F.max("c0").alias("max_c0")]).drop("live_ratio")


@query("block_fill_factor", f"WITH {EV} SELECT block_id, avg(CASE WHEN tombstone THEN 0 ELSE 1 END) AS live_ratio FROM ev GROUP BY block_id")
def block_fill_factor(spark, sf):
    return blocks.block_stats(events(spark, sf)).select("block_id", "live_ratio")


@query("block_has_live_at", f"WITH {EV} SELECT block_id, bool_or(revision <= {AS_OF} AND NOT tombstone) AS has_live FROM ev GROUP BY block_id")
def block_has_live_at(spark, sf):
    return blocks.has_live_at(events(spark, sf), _revision_at(events(spark, sf)))


EV_POINTS = "SELECT DISTINCT user_id AS x0, CAST(hour(ts) AS BIGINT) AS x1 FROM events"
EV_MIN_KEYS = "min(hkey) AS hkey_min FROM events e JOIN keyed k ON k.o0 = e.user_id AND k.o1 = hour(e.ts) GROUP BY e.event_id // 256"


def _min_keys(spark, sf):
    key = hilbert_key([F.col("c0"), F.col("c1")], 8)
    return events(spark, sf).groupBy("block_id").agg(F.min(key).alias("hkey_min"))


@query("block_min_key", _sql_hilbert(EV_POINTS, 2, 8, f"SELECT e.event_id // 256 AS block_id, {EV_MIN_KEYS}"))
def block_min_key(spark, sf):
    return _min_keys(spark, sf)


@query("block_coverage", _sql_hilbert(EV_POINTS, 2, 8, f", b AS (SELECT e.event_id // 256 AS block_id, {EV_MIN_KEYS}) SELECT block_id, hkey_min, lead(hkey_min) OVER (ORDER BY hkey_min, block_id) AS next_hkey FROM b"))
def block_coverage(spark, sf):
    return order.coverage_gaps(_min_keys(spark, sf).withColumn("space", F.lit(1))).drop("space")


@query("compact_keep_history", f"WITH {EV}, n AS (SELECT *, (row_number() OVER (ORDER BY c0, c1, revision) - 1) // 1000 AS block_no FROM ev) SELECT block_no, count(*) AS n_rows, min(revision) AS min_revision, max(revision) AS max_revision, min(c0) AS first_c0 FROM n GROUP BY block_no")
def compact_keep_history(spark, sf):
    done = blocks.compact(events(spark, sf).select("c0", "c1", "revision", "tombstone"), EV_KEY, CompactionConfig(1000))
    return done.groupBy("block_no").agg(F.count("*").alias("n_rows"), F.min("revision").alias("min_revision"), F.max("revision").alias("max_revision"), F.min("c0").alias("first_c0"))


@query("compact_latest", f"WITH {EV}, l AS ({LIVE}), k AS (SELECT * FROM l WHERE rn = 1) SELECT c0, c1, revision, tombstone, (row_number() OVER (ORDER BY c0, c1, revision) - 1) // 500 AS block_no FROM k")
def compact_latest(spark, sf):
    return blocks.compact(events(spark, sf).select("c0", "c1", "revision", "tombstone"), EV_KEY, CompactionConfig(500, retain_history=False))


@query("gc_retention_filter", f"WITH {EV} SELECT c0, c1, revision, tombstone FROM ev WHERE NOT tombstone OR revision >= 500")
def gc_retention_filter(spark, sf):
    return blocks.apply_retention(events(spark, sf), RetentionPolicy(tombstone_horizon=500)).select("c0", "c1", "revision", "tombstone")


@query("gc_version_horizon", f"WITH {EV}, m AS (SELECT *, max(revision) OVER (PARTITION BY c0, c1) AS newest FROM ev) SELECT c0, c1, revision, tombstone FROM m WHERE revision >= 800 OR revision = newest")
def gc_version_horizon(spark, sf):
    return blocks.apply_retention(events(spark, sf), RetentionPolicy(version_horizon=800), EV_KEY).select("c0", "c1", "revision", "tombstone")


SNAPSHOTS = "bl AS (SELECT block_id, max(revision) AS top FROM ev GROUP BY block_id), a AS (SELECT block_id FROM bl WHERE top <= 3000 OR block_id % 5 = 0), b AS (SELECT block_id FROM bl WHERE top > 1000 AND block_id % 3 <> 0)"


def _snapshots(spark, sf):
    bl = events(spark, sf).groupBy("block_id").agg(F.max("revision").alias("top"))
    return bl, bl.where("top <= 3000 OR block_id % 5 = 0").select("block_id"), bl.where("top > 1000 AND block_id % 3 <> 0").select("block_id")


@query("gc_safe_to_delete", f"WITH {EV}, {SNAPSHOTS} SELECT block_id FROM bl WHERE block_id NOT IN (SELECT block_id FROM a UNION SELECT block_id FROM b)")
def gc_safe_to_delete(spark, sf):
    bl, a, b = _snapshots(spark, sf)
    return join.safe_to_delete(bl.select("block_id"), a.union(b))


@query("snapshot_diff_blocks", f"WITH {EV}, {SNAPSHOTS} SELECT block_id FROM a EXCEPT SELECT block_id FROM b")
def snapshot_diff_blocks(spark, sf):
    _, a, b = _snapshots(spark, sf)
    return join.missing_blocks(a, b)


@query("snapshot_common_blocks", f"WITH {EV}, {SNAPSHOTS} SELECT block_id FROM a INTERSECT SELECT block_id FROM b")
def snapshot_common_blocks(spark, sf):
    _, a, b = _snapshots(spark, sf)
    return a.intersect(b)


@query("delta_added", f"WITH {EV}, {SNAPSHOTS} SELECT block_id FROM a WHERE block_id NOT IN (SELECT block_id FROM b)")
def delta_added(spark, sf):
    _, a, b = _snapshots(spark, sf)
    return join.delta(a, b)[0]


@query("delta_removed", f"WITH {EV}, {SNAPSHOTS} SELECT block_id FROM b WHERE block_id NOT IN (SELECT block_id FROM a)")
def delta_removed(spark, sf):
    _, a, b = _snapshots(spark, sf)
    return join.delta(a, b)[1]


@query("delta_apply", f"WITH {EV}, {SNAPSHOTS} SELECT block_id FROM a")
def delta_apply(spark, sf):
    _, a, b = _snapshots(spark, sf)
    added, removed = join.delta(a, b)
    return join.apply_delta(b, added, removed)


@query("memory_stats", f"WITH {STATE}, b AS (SELECT count(*) AS n, coalesce(sum(48 + length(event_type)), 0) AS s FROM st WHERE state = 'buffered'), c AS (SELECT count(DISTINCT block_id) AS k, coalesce(sum(48 + length(event_type)), 0) AS s FROM st WHERE state = 'sealed') SELECT b.n AS buffer_records, CAST(b.s AS BIGINT) AS buffer_bytes, c.k AS cached_blocks, c.k AS snapshot_entries, CAST(c.s + 64 * c.k AS BIGINT) AS cache_bytes, CAST(b.s + c.s + 64 * c.k + 24 * c.k + 4096 AS BIGINT) AS total_bytes FROM b, c")
def memory_stats(spark, sf):
    st = event_state(spark, sf)
    sealed = st.where("state = 'sealed'")
    return blocks.memory_stats(st.where("state = 'buffered'"), sealed, sealed.select("block_id").distinct(), F.octet_length("event_type"))


ROW_SQL = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("c0", "c1", "revision", "event_type"))


@query("checksum_per_block", f"WITH {EV} SELECT block_id, sha256(string_agg({ROW_SQL}, chr(10) ORDER BY revision)) AS checksum FROM ev GROUP BY block_id")
def checksum_per_block(spark, sf):
    return blocks.block_checksums(events(spark, sf), ["revision"], ["c0", "c1", "revision", "event_type"])


# ---- trees

LEAVES_SQL = f"leaves AS (SELECT block_id AS idx, sha256(string_agg({ROW_SQL}, chr(10) ORDER BY revision)) AS hash FROM ev GROUP BY block_id)"
ZERO_SQL = "repeat('0', 64)"
TREE_SQL = f"""sz AS (SELECT CAST(2 ** ceil(log2(max(idx) + 1)) AS BIGINT) AS n FROM leaves),
padded AS (SELECT i AS idx, coalesce(hash, {ZERO_SQL}) AS hash FROM (SELECT unnest(range(n)) AS i FROM sz) LEFT JOIN leaves ON idx = i),
tree AS (SELECT 0 AS level, idx, hash FROM padded UNION ALL
  SELECT l.level + 1, l.idx // 2, sha256(unhex(l.hash) || unhex(r.hash)) FROM tree l JOIN tree r ON l.idx % 2 = 0 AND r.idx = l.idx + 1)"""


def _leaves(spark, sf):
    return blocks.block_checksums(events(spark, sf), ["revision"], ["c0", "c1", "revision", "event_type"]).select(F.col("block_id").alias("idx"), F.col("checksum").alias("hash"))


@query("merkle_level_hashes", f"WITH RECURSIVE {EV}, {LEAVES_SQL}, {TREE_SQL} SELECT CAST(level AS INTEGER) AS level, idx, hash FROM tree")
def merkle_level_hashes(spark, sf):
    return merkle.levels(_leaves(spark, sf))


@query("merkle_root", f"WITH RECURSIVE {EV}, {LEAVES_SQL}, {TREE_SQL} SELECT hash FROM tree WHERE level = (SELECT max(level) FROM tree)")
def merkle_root(spark, sf):
    return merkle.root(_leaves(spark, sf))


@query("merkle_diff_leaves", f"WITH {EV}, {LEAVES_SQL}, other AS (SELECT idx, CASE WHEN idx % 7 = 3 THEN {ZERO_SQL} ELSE hash END AS hash FROM leaves) SELECT l.idx FROM leaves l JOIN other o ON l.idx = o.idx WHERE l.hash <> o.hash")
def merkle_diff_leaves(spark, sf):
    leaves = _leaves(spark, sf)
    return merkle.diff_leaves(leaves, leaves.withColumn("hash", F.when(F.col("idx") % 7 == 3, merkle.ZERO).otherwise(F.col("hash"))))


BLOCKS_SQL = f"k AS (SELECT block_id, sha256(string_agg({ROW_SQL}, chr(10) ORDER BY revision)) AS checksum FROM ev GROUP BY block_id)"


def _holders(spark, sf):
    mine = blocks.block_checksums(events(spark, sf), ["revision"], ["c0", "c1", "revision", "event_type"])
    stale = F.when(F.col("block_id") % 5 == 2, merkle.ZERO).otherwise(F.col("checksum")).alias("checksum")
    return mine, mine.where("block_id % 4 <> 1").select("block_id", stale)


@query("sync_differing_blocks", f"WITH {EV}, {BLOCKS_SQL} SELECT block_id FROM k WHERE block_id % 4 = 1 OR block_id % 5 = 2")
def sync_differing_blocks(spark, sf):
    return sync.differing_blocks(*_holders(spark, sf))


@query("sync_bring_up_to_date", f"WITH {EV}, {BLOCKS_SQL} SELECT block_id, checksum FROM k")
def sync_bring_up_to_date(spark, sf):
    return sync.bring_up_to_date(*_holders(spark, sf))


@query("snapshot_message_round_trip", f"WITH {EV} SELECT block_id, count(*) AS n_rows, min(revision) AS min_revision, max(revision) AS max_revision FROM ev GROUP BY block_id")
def snapshot_message_round_trip(spark, sf):
    listed = blocks.block_stats(events(spark, sf)).drop("live_ratio")
    return sync.decode_snapshot(sync.encode_snapshot(listed), "block_id long, n_rows long, min_revision long, max_revision long")


@query("cache_residents", f"WITH {EV}, b AS (SELECT block_id, max(revision) AS used, CAST(64 + sum(48 + length(event_type)) AS BIGINT) AS size FROM ev GROUP BY block_id), r AS (SELECT *, sum(size) OVER (ORDER BY used DESC, block_id) AS running FROM b) SELECT block_id, size, CAST(running AS BIGINT) AS running FROM r WHERE running <= 100000")
def cache_residents(spark, sf):
    b = events(spark, sf).groupBy("block_id").agg(F.max("revision").alias("used"), (blocks.BLOCK_BYTES + F.sum(blocks.RECORD_BYTES + F.length("event_type"))).cast("long").alias("size"))
    return sync.cache_residents(b, 100_000, last_used="used", size="size").drop("used")


# ---- replication

OUTBOX_SQL = "ob AS (SELECT event_id + 1 AS op_id, CAST(event_id % 4 AS INTEGER) AS attempts, (event_id * 7919) % 100000 AS next_attempt_at_ms, CAST(NULL AS VARCHAR) AS last_error FROM events), due AS (SELECT * FROM ob WHERE next_attempt_at_ms <= 50000 ORDER BY op_id LIMIT 300), rs AS (SELECT op_id, CASE op_id % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'conflict_stale' ELSE 'ack' END AS result, CASE op_id % 5 WHEN 0 THEN 'offline' END AS error FROM ob WHERE op_id % 7 <> 0)"


def _outbox(spark, sf):
    i = F.col("event_id")
    ob = table(spark, sf, "events").select((i + 1).alias("op_id"), (i % 4).cast("int").alias("attempts"), ((i * 7919) % 100000).alias("next_attempt_at_ms"), F.lit(None).cast("string").alias("last_error"))
    o = F.col("op_id")
    first = ob.where("op_id % 7 <> 0").select("op_id", F.lit(0).alias("position"), F.when(o % 5 == 0, "retry").when(o % 5 == 1, "conflict_stale").otherwise("ack").alias("result"), F.when(o % 5 == 0, "offline").alias("error"))
    second = first.where("op_id % 3 = 0").select("op_id", F.lit(1).alias("position"), F.lit("ack").alias("result"), F.lit(None).cast("string").alias("error"))
    return ob, outbox.due_batch(ob, 50000, 300), first.union(second)


@query("outbox_due_batch", f"WITH {OUTBOX_SQL} SELECT op_id, attempts, next_attempt_at_ms FROM due")
def outbox_due_batch(spark, sf):
    return _outbox(spark, sf)[1].drop("last_error")


@query("outbox_apply_results", f"""WITH {OUTBOX_SQL}, j AS (SELECT ob.*, due.op_id IS NOT NULL AS d, coalesce(rs.result, 'retry') AS r, rs.error FROM ob LEFT JOIN due ON due.op_id = ob.op_id LEFT JOIN rs ON rs.op_id = ob.op_id)
SELECT op_id, CAST(CASE WHEN d THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts,
  CAST(CASE WHEN d THEN 60000 + least(1000 * (1 << CAST(least(attempts + 1, 6) AS INTEGER)), 60000) ELSE next_attempt_at_ms END AS BIGINT) AS next_attempt_at_ms,
  CASE WHEN d THEN coalesce(error, 'no result for this operation') ELSE last_error END AS last_error
FROM j WHERE NOT d OR r = 'retry'""")
def outbox_apply_results(spark, sf):
    ob, due, results = _outbox(spark, sf)
    return outbox.apply_results(ob, due, results, 60000)


@query("sync_report", f"WITH {OUTBOX_SQL}, j AS (SELECT coalesce(rs.result, 'retry') AS r FROM due LEFT JOIN rs USING (op_id)) SELECT count(*) AS attempted, count(*) FILTER (r = 'ack') AS acked, count(*) FILTER (r = 'retry') AS retried, count(*) FILTER (r = 'conflict_stale') AS dropped_stale FROM j")
def sync_report(spark, sf):
    _, due, results = _outbox(spark, sf)
    return outbox.sync_report(due, results)


@query("outbox_pending_count", f"WITH {OUTBOX_SQL} SELECT count(*) AS pending FROM ob")
def outbox_pending_count(spark, sf):
    return _outbox(spark, sf)[0].agg(F.count("*").alias("pending"))


@query("lww_conflict_stale", f"WITH {STATE}, r AS (SELECT c0, c1, max(revision) AS remote_revision FROM st WHERE state = 'buffered' GROUP BY c0, c1) SELECT s.c0, s.c1, s.revision, r.remote_revision FROM st s JOIN r ON r.c0 = s.c0 AND r.c1 = s.c1 WHERE s.state = 'sealed' AND r.remote_revision > s.revision")
def lww_conflict_stale(spark, sf):
    st = event_state(spark, sf).select("c0", "c1", "revision", "state")
    return outbox.stale(st.where("state = 'sealed'").drop("state"), st.where("state = 'buffered'").drop("state"), EV_KEY)


# ---- catalogs

SPACE_ROWS = [(1, "events", 2), (2, "lineitem", 3), (3, "lines", 2), (4, "parts", 2)]
GRANT_ROWS = [(1, "read_only"), (2, "read_write"), (3, "admin"), (1, "admin")]
BRANCH_ROWS = [(1, "main", 10, None, 0), (2, "feature", 10, 1, 300), (3, "hotfix", 12, 2, 600), (4, "side", 9, 1, 100)]


def sql_values(rows):
    return ", ".join(str(r).replace("None", "NULL") for r in rows)


@query("space_registry_lookup", f"WITH s(id, name, dims) AS (VALUES {sql_values(SPACE_ROWS)}) SELECT CAST(id AS BIGINT) AS id, name, CAST(dims AS INTEGER) AS dims FROM s WHERE name = 'lines'")
def space_registry_lookup(spark, sf):
    return values(spark, SPACE_ROWS, ["id", "name", "dims"], ["BIGINT", "STRING", "INT"]).where("name = 'lines'")


@query("access_filter", f"WITH {EV}, g(pos, space, level) AS (VALUES (0, 1, 'read_only'), (1, 2, 'read_write'), (2, 3, 'admin'), (3, 1, 'admin')), f AS (SELECT space, level FROM g WHERE pos = (SELECT min(pos) FROM g x WHERE x.space = g.space)), v AS (SELECT 1 + revision % 4 AS space, c0, c1, revision FROM ev) SELECT CAST(v.space AS BIGINT) AS space, c0, c1, revision FROM v JOIN f ON f.space = v.space WHERE f.level IN ('read_write', 'admin')")
def access_filter(spark, sf):
    grants = values(spark, [(i, *g) for i, g in enumerate(GRANT_ROWS)], ["pos", "space", "level"], ["INT", "BIGINT", "STRING"])
    first = grants.withColumn("k", F.row_number().over(Window.partitionBy("space").orderBy("pos"))).where("k = 1 AND level IN ('read_write', 'admin')")
    versions = events(spark, sf).select((1 + F.col("revision") % 4).alias("space"), "c0", "c1", "revision")
    return versions.join(F.broadcast(first.select("space")), "space", "left_semi")


@query("branch_lineage", f"WITH RECURSIVE b(id, name, head, parent, forked_at) AS (VALUES {sql_values(BRANCH_ROWS)}), l AS (SELECT id AS branch, id, parent, 0 AS depth FROM b UNION ALL SELECT l.branch, b.id, b.parent, depth + 1 FROM l JOIN b ON b.id = l.parent) SELECT CAST(branch AS BIGINT) AS branch, CAST(id AS BIGINT) AS ancestor, CAST(depth AS INTEGER) AS depth FROM l")
def branch_lineage(spark, sf):
    from gridlore.operators.branch import lineage

    return lineage(values(spark, BRANCH_ROWS, ["id", "name", "head", "parent", "forked_at"], ["BIGINT", "STRING", "BIGINT", "BIGINT", "BIGINT"]))


FORKED_SQL = f"(SELECT {FORKED} * max(revision) // 100 FROM ev)"


@query("branch_read_at_fork", f"WITH {EV}, u AS (SELECT c0, c1, revision, tombstone FROM ev WHERE revision <= {FORKED_SQL} UNION ALL SELECT c0, c1, revision, tombstone FROM ev WHERE revision > {FORKED_SQL}), l AS (SELECT *, row_number() OVER (PARTITION BY c0, c1 ORDER BY revision DESC) AS rn FROM u) SELECT c0, c1, revision FROM l WHERE rn = 1 AND NOT tombstone")
def branch_read_at_fork(spark, sf):
    from gridlore.operators.branch import read_branch

    ev = events(spark, sf).select("c0", "c1", "revision", "tombstone")
    fork = _revision_at(ev, FORKED)
    return read_branch(ev, ev.where(F.col("revision") > fork), EV_KEY, forked_at=fork).select("c0", "c1", "revision")


# ---- the store: what is written through it is read back

def _stored(spark, sf, flush: bool = True, **given):
    """A store in a scratch folder with all events as one space, written in their order, so that revisions are theirs."""
    from gridlore.model import SpaceConfig
    from gridlore.sources.store import GridStore
    from gridlore.streaming.state import scratch

    store = GridStore(spark, scratch(spark, "store"), **given)
    store.register_space(SpaceConfig(1, "events", 2))
    rows = table(spark, sf, "events").select(F.col("user_id").alias("c0"), F.hour("ts").cast("long").alias("c1"), "event_id", "event_type", "value")
    store.insert(1, rows, order=["event_id"])
    if flush:
        store.flush(1, rows_per_block=max(1, rows.count() // 8))
    return store, rows


STORED = ["c0", "c1", "revision", "event_type", "value"]


@query("store_delete_read", f"WITH {EV}, l AS ({LIVE}) SELECT {SHOWN_SQL} FROM l WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ev t WHERE t.tombstone AND t.c0 = l.c0 AND t.c1 = l.c1)")
def store_delete_read(spark, sf):
    """Insert and flush all, delete every address that ever had an error, read the current state."""
    store, rows = _stored(spark, sf)
    store.delete(1, rows.where("event_type = 'error'").select("c0", "c1").distinct())
    return store.read(ReadQuery(1)).select(*STORED)


@query("store_box_read", f"WITH {EV} SELECT {SHOWN_SQL} FROM ev WHERE revision <= {AS_OF} AND c0 BETWEEN 3 AND 40 AND c1 BETWEEN 2 AND 11")
def store_box_read(spark, sf):
    """A box as of a revision, from the blocks whose keys may lie in it, each verified by its checksum."""
    store, _ = _stored(spark, sf)
    box = ReadQuery(1).with_box((3, 2), (40, 11)).at(_revision_at(events(spark, sf)))
    return store.read(box, mode="versions", verify=True).select(*STORED)


@query("store_compact_read", f"WITH {EV}, l AS ({LIVE}) SELECT {SHOWN_SQL} FROM l WHERE rn = 1")
def store_compact_read(spark, sf):
    """Compacted to the latest version of each address; the blocks before are deleted."""
    store, _ = _stored(spark, sf)
    store.compact(1, CompactionConfig(4096, retain_history=False))
    store.vacuum(1)
    return store.sealed(1).select(*STORED)


@query("store_block_listing", "SELECT CAST(count(*) AS BIGINT) AS n_rows, min(event_id) + 1 AS min_revision, max(event_id) + 1 AS max_revision, CAST(1 AS BIGINT) AS snapshot_id FROM events")
def store_block_listing(spark, sf):
    store, _ = _stored(spark, sf)
    return store.manifest(1).agg(F.sum("n_rows").alias("n_rows"), F.min("min_revision").alias("min_revision"), F.max("max_revision").alias("max_revision"), F.max("snapshot_id").alias("snapshot_id"))


@query("store_dispatch", f"WITH {EV}, l AS ({LIVE}) SELECT {SHOWN_SQL} FROM l WHERE rn = 1")
def store_dispatch(spark, sf):
    """The unflushed buffer, read by request under a session that may only read."""
    from gridlore.model import READ_ONLY, Session, SpaceGrant
    from gridlore.server import Read, dispatch, handlers_of

    store, _ = _stored(spark, sf, flush=False)
    return dispatch(Read(ReadQuery(1)), Session((SpaceGrant(1, READ_ONLY),)), handlers_of(store)).value.select(*STORED)


@query("store_writes_replicated", "SELECT count(*) AS pending, min(event_id) + 1 AS first_op, max(event_id) + 1 AS last_op FROM events")
def store_writes_replicated(spark, sf):
    """Every version written is an operation of the outbox."""
    from gridlore.streaming.replicate import Outbox
    from gridlore.streaming.state import scratch

    queue = Outbox(spark, scratch(spark, "queue"))
    _stored(spark, sf, flush=False, on_write=lambda space, versions: queue.enqueue(versions, 0))
    return queue.load().agg(F.count("*").alias("pending"), F.min("op_id").alias("first_op"), F.max("op_id").alias("last_op"))


@query("store_spaces", f"WITH s(id, name, dims) AS (VALUES {sql_values(SPACE_ROWS)}) SELECT CAST(id AS BIGINT) AS id, name, CAST(dims AS INTEGER) AS dims FROM s WHERE id <> 2")
def store_spaces(spark, sf):
    """Spaces registered and one removed, in the store's catalog."""
    from gridlore.model import SpaceConfig
    from gridlore.sources.store import GridStore
    from gridlore.streaming.state import scratch

    store = GridStore(spark, scratch(spark, "store"))
    for row in SPACE_ROWS:
        store.register_space(SpaceConfig(*row))
    store.remove_space(2)
    return store.spaces()


# ---- streams; what they leave is compared as a batch

@query("stream_latest_state", f"WITH {EV}, l AS ({LIVE}) SELECT c0, c1, revision FROM l WHERE rn = 1 AND NOT tombstone")
def stream_latest_state(spark, sf):
    from gridlore.streaming.state import latest_from_log

    return latest_from_log(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, _as_versions, EV_KEY).where(~F.col("tombstone")).select("c0", "c1", "revision")


def _as_versions(log: DataFrame) -> DataFrame:
    return log.select(F.col("user_id").alias("c0"), F.hour("ts").cast("long").alias("c1"), (F.col("event_id") + 1).alias("revision"), (F.col("event_type") == "error").alias("tombstone"))


@query("stream_outbox_drain", "SELECT count(*) AS sent FROM events")
def stream_outbox_drain(spark, sf):
    from gridlore.streaming.replicate import drain_log

    return drain_log(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, _as_versions)


assert BLOCK == 256
