"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridlore.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def tidy(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(tidy(r[c]) for c in cols)) for r in df.collect())
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(tidy(x[i]) for i in at)) for x in r.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_is_the_current_state(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["c0", "c1", "revision", "event_type", "value"]
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_lineitem_gets_a_revision(spark, sf):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert sorted(r["revision"] for r in QUERIES["revision_assignment"](spark, sf).collect()) == list(range(5001, 5001 + n))


def test_every_lineitem_point_gets_a_key(spark, sf):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_partkey", "l_suppkey", "l_quantity").distinct().count()
    assert QUERIES["hilbert_encode_3d"](spark, sf).count() == n


def test_every_overtaken_write_is_judged_and_reads_grow_with_the_log(spark, sf):
    ev = [((r["user_id"], r["ts"].hour), r["event_id"] + 1, r["event_type"] == "error") for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    most = max(r for _, r, _ in ev)
    sealed = int(0.8 * most)
    newest = {}
    for k, r, _ in ev:
        if r > sealed:
            newest[k] = max(r, newest.get(k, 0))
    got = QUERIES["lww_conflict_stale"](spark, sf).collect()
    assert sorted((r["c0"], r["c1"], r["revision"], r["remote_revision"]) for r in got) == sorted((*k, r, newest[k]) for k, r, _ in ev if r <= sealed and k in newest)
    live = {k: (r, gone) for k, r, gone in sorted(ev, key=lambda x: x[1])}
    got = QUERIES["branch_read_at_fork"](spark, sf).collect()
    assert sorted((r["c0"], r["c1"], r["revision"]) for r in got) == sorted((*k, r) for k, (r, gone) in live.items() if not gone)
    assert QUERIES["scan_include_tombstones"](spark, sf).count() == int(0.7 * most)


def test_a_branch_hides_its_base_after_the_fork(spark):
    from gridlore.operators.branch import read_branch

    base = spark.createDataFrame([(1, 1, False), (1, 5, False), (2, 6, False)], "c0 long, revision long, tombstone boolean")
    own = spark.createDataFrame([(3, 7, False)], base.schema)
    assert sorted(tuple(r)[:2] for r in read_branch(base, own, ["c0"], forked_at=4).select("c0", "revision").collect()) == [(1, 1), (3, 7)]
