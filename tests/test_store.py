import pytest

from gridlore.model import (
    ADMIN, READ_ONLY, READ_WRITE, BadShape, BranchNotFound, CompactionConfig, CorruptBlock, DuplicateBranch, DuplicateSpace, PointSchema, Query, RetentionPolicy, Session, SpaceConfig, SpaceGrant, SpaceNotFound,
)
from gridlore.server import CreateBranch, Delete, GetSnapshot, Ping, Read, Write, dispatch, handlers_of
from gridlore.sources.store import GridStore


@pytest.fixture
def store(spark, tmp_path):
    s = GridStore(spark, str(tmp_path / "store"))
    s.register_space(SpaceConfig(1, "points", 2))
    return s


def put(store, *rows):
    return store.insert(1, store.spark.createDataFrame(rows, "c0 long, c1 long, data string"))


def drop(store, *points):
    return store.delete(1, store.spark.createDataFrame(points, "c0 long, c1 long"))


def seen(store, query=Query(1), mode="live"):
    return sorted((r["c0"], r["c1"], r["data"] if "data" in r.asDict() else None) for r in store.read(query, mode=mode).collect())


def test_unflushed_and_flushed_reads(store):
    put(store, (10, 20, "a"))
    assert seen(store) == [(10, 20, "a")]
    assert store.current_snapshot(1) is None
    assert store.flush(1) == 1 and store.flush(1) is None
    assert seen(store) == [(10, 20, "a")]
    assert store.current_snapshot(1) == 1


def test_update_delete_reinsert_flush(store):
    put(store, (1, 1, "old"), (2, 1, "x"))
    put(store, (1, 1, "new"))
    assert seen(store) == [(1, 1, "new"), (2, 1, "x")]
    assert seen(store, mode="versions") == [(1, 1, "new"), (1, 1, "old"), (2, 1, "x")]
    drop(store, (1, 1))
    assert seen(store) == [(2, 1, "x")]
    put(store, (1, 1, "again"))
    assert seen(store) == [(1, 1, "again"), (2, 1, "x")]
    assert seen(store, mode="faithful") == [(2, 1, "x")]  # a buffered tombstone hides even what came after
    store.flush(1)
    assert seen(store) == [(1, 1, "again"), (2, 1, "x")]
    assert len(seen(store, mode="faithful")) == 4  # sealed tombstones hide nothing


def test_as_of_and_reopen(spark, store):
    first = put(store, (1, 0, "a"))
    store.flush(1)
    put(store, (2, 0, "b"))
    assert seen(store, Query(1).at(first)) == [(1, 0, "a")]
    again = GridStore(spark, store.root)
    assert seen(again) == [(1, 0, "a"), (2, 0, "b")]
    assert again.revision() == 2 and put(again, (3, 0, "c")) == 3


def test_boxes_prefixes_keys(store):
    put(store, *[(x, y, "") for x in range(4) for y in range(4)], (256, 0, "alias"))
    store.flush(1)
    box = Query(1).with_box((1, 1), (2, 2))
    assert [p[:2] for p in seen(store, box)] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert [p[:2] for p in seen(store, Query(1).with_prefix(3))] == [(3, 0), (3, 1), (3, 2), (3, 3)]
    assert (256, 0, "alias") not in seen(store, Query(1).with_box((0, 0), (0, 0)))
    assert seen(store, Query(1).with_key_range(0, -1)) == []
    with pytest.raises(BadShape):
        store.read(Query(1).with_box((1, 1, 1), (2, 2, 2)))
    with pytest.raises(BadShape):
        store.read(Query(1).with_prefix(1, 2, 3))
    with pytest.raises(BadShape):
        Query(1).with_box((1,), (1, 2))


def test_bad_rows_are_refused(store):
    with pytest.raises(BadShape):
        store.insert(1, store.spark.createDataFrame([(1,)], "c0 long"))
    with pytest.raises(Exception, match="unsigned 32-bit"):
        put(store, (-1, 0, "a"))
    with pytest.raises(SpaceNotFound):
        store.insert(9, store.spark.createDataFrame([(1, 1)], "c0 long, c1 long"))


def test_spaces(store):
    with pytest.raises(DuplicateSpace, match="space 1"):
        store.register_space(SpaceConfig(1, "points", 2))
    with pytest.raises(DuplicateSpace, match="named"):
        store.register_space(SpaceConfig(2, "points", 2))
    with pytest.raises(BadShape):
        SpaceConfig(3, "wide", 17)
    assert store.space("points") == store.space(1)
    assert store.remove_space(1).name == "points"
    with pytest.raises(SpaceNotFound):
        store.space(1)


def test_branches(store):
    put(store, (1, 1, "a"))
    assert store.create_branch("feature") != store.branch("main")["id"]
    assert store.branch("feature")["parent"] == 1 and store.branch("feature")["forked_at"] == 1
    with pytest.raises(DuplicateBranch):
        store.create_branch("feature")
    with pytest.raises(BranchNotFound):
        store.create_branch("x", "nobody")
    store.advance_branch("feature", 7)
    assert store.branch("feature")["head"] == 7 and store.branch("main")["head"] is None


def test_snapshots_chain_and_stay_readable(store):
    put(store, (1, 1, "a"))
    one = store.flush(1)
    put(store, (2, 2, "b"))
    two = store.flush(1)
    assert {r["parent"] for r in store.manifest(1, two).collect()} == {one}
    assert seen(store, Query(1, snapshot=one)) == [(1, 1, "a")]
    assert seen(store) == [(1, 1, "a"), (2, 2, "b")]


def test_compaction(store):
    put(store, (1, 0, "a"))
    store.flush(1)
    put(store, (1, 0, "b"))
    drop(store, (5, 5))
    store.flush(1)
    put(store, (9, 9, "buffered"))
    store.compact(1, CompactionConfig(10, retain_history=False), RetentionPolicy(tombstone_horizon=100))
    assert store.sealed(1).count() == 1
    assert seen(store) == [(1, 0, "b"), (9, 9, "buffered")]


def test_compaction_numbers_blocks_and_vacuum_deletes_the_old(store):
    put(store, (1, 0, "a"))
    one = store.flush(1)
    put(store, (1, 0, "b"))
    store.flush(1)
    store.compact(1, CompactionConfig(10), next_block=iter(range(500, 600)).__next__)
    assert [r["block_id"] for r in store.manifest(1).collect()] == [500] and store.has_block(1, 500) and not store.has_block(1, 1)
    assert [r["block_id"] for r in store.manifest(1, one).collect()] == [1] and seen(store, Query(1, snapshot=one)) == [(1, 0, "a")]
    assert store.vacuum(1) == 2 and store.vacuum(1) == 0
    assert seen(store) == [(1, 0, "b")] and seen(store, mode="versions") == [(1, 0, "a"), (1, 0, "b")]


def test_a_crash_between_snapshot_and_log_doubles_nothing(store, monkeypatch):
    put(store, (1, 0, "a"), (2, 0, "b"))
    fs, path = store._fs()

    class Kept:
        def __getattr__(self, name):
            return (lambda *a: False) if name == "delete" else getattr(fs, name)

    monkeypatch.setattr(store, "_fs", lambda: (Kept(), path))
    store.flush(1)
    monkeypatch.undo()
    assert store.buffer(1) is None
    assert seen(store, mode="versions") == [(1, 0, "a"), (2, 0, "b")]
    assert put(store, (3, 0, "c")) == 3
    assert seen(store, mode="versions") == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c")]
    store.flush(1)
    assert seen(store, mode="versions") == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c")]


def test_blocks_off_the_box_are_not_opened_and_bad_ones_are_found(spark, store):
    high = 2**32 - 1
    put(store, (0, 0, "low"), (high, high, "high"))
    store.flush(1, rows_per_block=1)
    query = Query(1).with_box((0, 0), (9, 9))
    ranges = store.key_ranges(query, 2)
    assert store.sealed(1, ranges=ranges).count() == 1 and seen(store, query) == [(0, 0, "low")]
    assert store.read(query, verify=True).count() == 1
    target = store.manifest(1).where("hkey_min = 0").first()["path"]
    other = str(store.root) + "/other"
    spark.createDataFrame([(0, 0, 1, False, 0, "forged")], "c0 long, c1 long, revision long, tombstone boolean, hkey long, data string").coalesce(1).write.parquet(other)
    fs, path = store._fs()
    fs.delete(path(target), False)
    forged = next(f.getPath() for f in fs.listStatus(path(other)) if f.getPath().getName().startswith("part"))
    fs.rename(forged, path(target))
    with pytest.raises(CorruptBlock):
        store.read(query, verify=True)


def test_writes_are_handed_on_and_rows_are_projected(spark, tmp_path):
    given = []
    store = GridStore(spark, str(tmp_path / "hooked"), on_write=lambda space, versions: given.extend(tuple(r) for r in versions.select("c0", "revision", "tombstone").collect()))
    store.register_space(SpaceConfig(1, "p", 1))
    schema = PointSchema((lambda rows: rows["day"] * 24 + rows["hour"],), ("what",))
    store.insert(1, spark.createDataFrame([(1, 2, "x")], "day long, hour long, what string"), schema=schema)
    store.delete(1, spark.createDataFrame([(26,)], "c0 long"))
    assert given == [(26, 1, False), (26, 2, True)]
    assert [r["what"] for r in store.read(Query(1), mode="versions").collect()] == ["x"]


def test_dispatch(spark, store):
    h = handlers_of(store)
    reader, writer, nobody = (Session((SpaceGrant(1, READ_ONLY), SpaceGrant(1, ADMIN))), Session((SpaceGrant(1, READ_WRITE),)), Session())
    rows = spark.createDataFrame([(0, 0, "a")], "c0 long, c1 long, data string")
    assert dispatch(Ping(), nobody, h).kind == "pong"
    assert dispatch(Write(1, rows), reader, h).kind == "unauthorised"  # the first grant counts
    assert dispatch(Write(1, rows), writer, h).value == 1
    assert dispatch(Read(Query(1)), nobody, h).kind == "unauthorised"
    assert dispatch(Read(Query(1)), reader, h).value.count() == 1
    assert dispatch(Delete(1, rows), writer, h).value == 2
    assert dispatch(CreateBranch("b"), nobody, h).kind == "branch"
    assert dispatch(CreateBranch("c"), nobody, h, strict=True).kind == "unauthorised"
    assert dispatch(GetSnapshot(1), nobody, h).value is None
    assert dispatch(CreateBranch("b"), writer, h).kind == "internal"
    assert reader.access(99) is None and not reader.can_write(1) and len(reader.hex) == 32
