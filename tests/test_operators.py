import random

import pytest
from pyspark.sql import functions as F

from gridlore.functions import clock
from gridlore.model import BadShape, CompactionConfig, RetentionPolicy
from gridlore.operators import blocks, join, merkle, order, outbox, scan
from gridlore.operators.branch import lineage
from gridlore.streaming.replicate import Outbox, run_outbox
from gridlore.streaming.state import receive_stream, tick_stream

V = "c0 long, revision long, tombstone boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_faithful_scan_equals_a_model(spark):
    """Random histories of insert, delete and flush against a direct simulation."""
    rnd = random.Random(5)
    for _ in range(4):
        sealed, buffer, data = [], [], []
        for rev in range(1, 40):
            if rnd.random() < 0.08:
                sealed, buffer = sealed + buffer, []
                continue
            buffer.append((rnd.randrange(5), rev, rnd.random() < 0.3))
        data = [(*v, "sealed") for v in sealed] + [(*v, "buffered") for v in buffer]
        df = spark.createDataFrame(data, V + ", state string")
        for as_of in (None, 20):
            ok = lambda v: as_of is None or v[1] <= as_of  # noqa: E731, B023
            dead = {v[0] for v in buffer if v[2] and ok(v)}
            want = sorted(v[:2] for v in sealed + buffer if ok(v) and not v[2] and v[0] not in dead)
            assert rows(scan.scan_faithful(df, ["c0"], "state", as_of), "c0", "revision") == want
            last = {}
            for v in sealed + buffer:
                if ok(v):
                    last[v[0]] = v
            assert rows(scan.scan_live(df, ["c0"], as_of), "c0", "revision") == sorted(v[:2] for v in last.values() if not v[2])


def test_boxes_need_matching_dims():
    with pytest.raises(BadShape):
        scan.within(["c0"], (1, 2), (1, 2))


def test_range_join_equals_brute_force(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.randrange(4000), rnd.randrange(4000)) for i in range(300)]
    boxes = []
    for b in range(60):
        x, y, w = rnd.randrange(4000), rnd.randrange(4000), rnd.choice([0, 1, 7, 8, 63, 900, 5000])
        boxes.append((b, x, x + w, y, y + rnd.choice([0, 3, w])))
    boxes.append((99, 5, 1, 0, 9))  # no point lies in an inverted box
    got = join.range_join(spark.createDataFrame(pts, "i int, x long, y long"), spark.createDataFrame(boxes, "b int, x0 long, x1 long, y0 long, y1 long"), [("x", "x0", "x1"), ("y", "y0", "y1")])
    assert rows(got, "i", "b") == sorted((i, b) for i, x, y in pts for b, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    none = spark.createDataFrame([], "b int, x0 long, x1 long")
    assert join.range_join(spark.createDataFrame(pts, "i int, x long, y long"), none, [("x", "x0", "x1")]).count() == 0


def test_compaction_merges_and_keeps_latest(spark):
    df = spark.createDataFrame([(1, 1, False), (2, 1, False), (3, 1, False), (4, 1, False)], V)
    assert blocks.compact(df, ["c0"]).select("block_no").distinct().count() == 1
    two = spark.createDataFrame([(1, 1, False), (1, 2, True)], V)
    once = blocks.compact(two, ["c0"], CompactionConfig(retain_history=False))
    assert rows(once, "c0", "revision", "tombstone") == [(1, 2, True)]
    assert rows(blocks.compact(once.drop("block_no"), ["c0"], CompactionConfig(retain_history=False)), "c0", "revision") == [(1, 2)]
    with pytest.raises(BadShape):
        CompactionConfig(0)


def test_retention(spark):
    df = spark.createDataFrame([(1, 1, True), (2, 5, True), (3, 3, False)], V)
    assert rows(blocks.apply_retention(df, RetentionPolicy(5)), "revision") == [(3,), (5,)]
    assert blocks.apply_retention(df, RetentionPolicy.keep_all()).count() == 3


def test_merkle(spark):
    h = lambda x: f"{x:064x}"
    leaves = lambda *xs: spark.createDataFrame([(i, h(x)) for i, x in enumerate(xs)], "idx long, hash string")
    a, b = leaves(1, 2, 3), leaves(1, 9, 3)
    assert merkle.root(a).first()[0] == merkle.root(leaves(1, 2, 3)).first()[0] != merkle.root(b).first()[0]
    assert rows(merkle.diff_leaves(a, b), "idx") == [(1,)]
    assert rows(merkle.diff_leaves(leaves(1, 2, 3, 4, 5), leaves(1, 2, 3)), "idx") == [(3,), (4,)]
    assert merkle.root(spark.createDataFrame([], "idx long, hash string")).first()[0] == merkle.ZERO
    assert merkle.levels(a).count() == 7
    for n in (1, 2, 3, 5, 64, 65, 200):
        some = spark.createDataFrame([(i, h(i * 7)) for i in range(n) if i % 3 != 1 or i == n - 1], "idx long, hash string")
        tree = merkle.levels(some)
        assert merkle.root(some).first()[0] == tree.orderBy(F.col("level").desc()).first()["hash"]


def test_checksums_tell_rows_apart(spark):
    kinds = [[("a|b", "c")], [("a", "b|c")], [(None, "")], [("", None)], [("", "")], [("1:a", "")], [("a", "")], [("a", "b"), ("c", "d")], [("a", "b\n1:c1:d")]]
    df = spark.createDataFrame([(i, k, *r) for i, rs in enumerate(kinds) for k, r in enumerate(rs)], "block_id long, revision long, x string, y string")
    assert blocks.block_checksums(df, ["revision"], ["x", "y"]).select("checksum").distinct().count() == len(kinds)


def test_small_helpers(spark):
    pairs = spark.createDataFrame([(1, 5, 2, 0), (2, 1, 2, 1), (2, 1, 2, 3), (3, 0, 2, 9)], "a long, x int, b long, y int")
    assert [r[0] for r in pairs.select(clock.earlier(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()] == [True, False, True, False]
    a, b = (spark.createDataFrame([(i,) for i in ids], "block_id long") for ids in ([1, 2], [2, 1]))
    assert join.delta_is_empty(*join.delta(a, b)) and not join.delta_is_empty(*join.delta(a, b.where("block_id = 1")))


def test_delta(spark):
    blk = lambda *ids: spark.createDataFrame([(i,) for i in ids], "block_id long")
    added, removed = join.delta(blk(10), blk())
    assert (rows(added, "block_id"), rows(removed, "block_id")) == ([(10,)], [])
    added, removed = join.delta(blk(5), blk(5))
    assert added.isEmpty() and removed.isEmpty()
    added, removed = join.delta(blk(1, 2), blk(2, 3))
    assert rows(join.apply_delta(blk(2, 3), added, removed), "block_id") == [(1,), (2,)]
    assert rows(join.safe_to_delete(blk(1, 2), blk(2, 7)), "block_id") == [(1,)]


def test_numbering_and_prefix(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 501).alias("x"))
    got = sorted((r["x"], r["n"]) for r in order.number_rows(df, ["x"], "n", 10).collect())
    assert [n for _, n in got] == list(range(10, 510))
    log = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, None)], "pos long, ok boolean")
    assert rows(order.latest_prefix(log, "pos", "ok"), "pos") == [(1,), (2,)]
    assert order.latest_prefix(log.where("pos < 3"), "pos", "ok").count() == 2


def test_lineage(spark):
    b = spark.createDataFrame([(1, "main", None), (2, "a", 1), (3, "b", 2)], "id long, name string, parent long")
    assert rows(lineage(b), "branch", "ancestor", "depth") == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (3, 3, 0)]


def respond(kind, error=None):
    return lambda due: due.select("op_id", F.lit(0).alias("position"), F.lit(kind).alias("result"), F.lit(error).cast("string").alias("error"))


def test_outbox_life(spark, tmp_path):
    folder = str(tmp_path / "outbox")
    box = Outbox(spark, folder)
    box.enqueue(spark.createDataFrame([(1, 3, False), (2, 4, True)], V), 1000)
    assert Outbox(spark, folder).pending() == 2  # a new handle finds the queue
    box.enqueue(spark.createDataFrame([(1, 3, False)], V), 1000)
    assert box.pending() == 2
    assert box.step(respond("retry", "offline"), 1000, 16) == {"attempted": 2, "acked": 0, "retried": 2, "dropped_stale": 0}
    state = box.load().collect()
    assert {(r["attempts"], r["next_attempt_at_ms"], r["last_error"]) for r in state} == {(1, 3000, "offline")}
    assert box.step(respond("ack"), 2000, 16)["attempted"] == 0  # not due yet

    def broken(due):
        raise OSError("no route")

    assert box.step(broken, 3000, 1)["retried"] == 1
    assert box.step(respond("conflict_stale", "stale write"), 3000, 16)["dropped_stale"] == 1
    assert box.step(respond("ack"), 10_000, 16)["acked"] == 1 and box.pending() == 0


def test_backoff(spark):
    got = [r[0] for r in spark.range(1, 9).select(outbox.backoff_ms(F.col("id"))).collect()]
    assert got == [2000, 4000, 8000, 16000, 32000, 60000, 60000, 60000]


def test_streams(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([(i % 3, i + 1, False) for i in range(9)], V).repartition(3).write.parquet(log)
    stream = spark.readStream.schema(V).option("maxFilesPerTrigger", 1).parquet(log)
    run_outbox(stream, respond("ack"), str(tmp_path / "box")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "box/reports/*")).agg(F.sum("acked")).first()[0] == 9
    assert Outbox(spark, str(tmp_path / "box")).pending() == 0
    ticks = tick_stream(stream.select(F.lit(1).alias("node"), F.lit(5).alias("wall")), "node", "wall")
    ticks.writeStream.format("memory").queryName("ticks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("ticks"), "physical_ms", "logical") == [(5, i) for i in range(9)]


def test_clocks_of_a_stream_equal_the_batch(spark, tmp_path):
    """One micro-batch of many Arrow frames: the order is that of the whole batch."""
    rnd = random.Random(3)
    sent = [(i % 2, rnd.randrange(1, 50), rnd.randrange(1, 60), rnd.randrange(5)) for i in range(300)]
    log = str(tmp_path / "log")
    spark.createDataFrame(sent, "node long, wall long, rm long, rl int").repartition(3).write.parquet(log)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for name, made in (("t", lambda s: tick_stream(s, "node", "wall")), ("r", lambda s: receive_stream(s, "node", "wall", "rm", "rl"))):
            made(spark.readStream.schema("node long, wall long, rm long, rl int").parquet(log)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = ["wall", "rm", "rl"]
    df = spark.createDataFrame(sent, "node long, wall long, rm long, rl int")
    assert rows(spark.table("t"), "node", "now", "physical_ms", "logical") == rows(clock.tick_sequence(df, now="wall", order=["wall"], node=["node"]), "node", "wall", "physical_ms", "logical")
    want = clock.receive_sequence(df, remote_ms="rm", remote_logical="rl", now="wall", order=order, node=["node"])
    assert rows(spark.table("r"), "node", "now", "physical_ms", "logical") == rows(want, "node", "wall", "physical_ms", "logical")


def test_sync_status(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "status"))
    box.enqueue(spark.createDataFrame([(1, 1, False)], V), 0)
    assert box.status() == {"last_success_ms": None, "last_error": None, "pending": 1}
    box.step(respond("retry", "offline"), 1000, 9)
    assert box.status() == {"last_success_ms": None, "last_error": "offline", "pending": 1}
    box.step(respond("ack"), 9000, 9)
    assert box.status() == {"last_success_ms": 9000, "last_error": None, "pending": 0}
