import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlore.functions import clock, ordinal
from gridlore.functions.hilbert import CompositeKey, covering_ranges, decode_points, encode_points, hilbert_key, hilbert_point, key_of, quantize
from gridlore.model import BadShape

#: Curve keys of points at a number of bits.
GOLDEN = [
    ((0, 0), 4, 0), ((1, 0), 4, 1), ((0, 1), 4, 3), ((3, 3), 4, 10), ((7, 5), 4, 38), ((3, 1, 2), 4, 22), ((5, 5), 8, 34), ((256, 0), 8, 0), ((10, 20), 8, 884),
    ((10, 10), 8, 136), ((200, 200), 8, 41088), ((128, 64), 8, 55978), ((255, 0), 8, 65535), ((0, 255), 8, 21845), ((255, 255), 8, 43690), ((42,), 8, 42),
    ((255,) * 16, 8, int("aa" * 16, 16)), ((1,) + (0,) * 15, 8, 0x1FF),
]


@pytest.mark.parametrize("point,bits,key", GOLDEN)
def test_golden_keys(point, bits, key):
    assert key_of(point, bits) == key
    assert tuple(decode_points([key], len(point), bits)[0]) == tuple(c & ((1 << bits) - 1) for c in point)


def test_empty_point_has_key_zero():
    assert key_of((), 8) == 0


def test_column_form_equals_numpy(spark):
    rng = np.random.default_rng(1)
    for dims, bits in ((1, 8), (2, 8), (3, 5), (4, 15), (6, 10)):
        pts = rng.integers(0, 1 << bits, (40, dims))
        df = spark.createDataFrame([tuple(int(x) for x in p) for p in pts], [f"c{i}" for i in range(dims)])
        keyed = df.withColumn("k", hilbert_key([F.col(f"c{i}") for i in range(dims)], bits))
        back = keyed.withColumn("p", hilbert_point(F.col("k"), dims, bits)).collect()
        assert [r["k"] for r in back] == encode_points(pts, bits)
        assert all(list(r["p"]) == [r[f"c{i}"] for i in range(dims)] for r in back)


def test_wide_keys_are_ordered_bytes(spark):
    pts = [(255,) * 16, (1,) + (0,) * 15]
    df = spark.createDataFrame(pts, [f"c{i}" for i in range(16)])
    got = [bytes(r[0]) for r in df.select(hilbert_key([F.col(f"c{i}") for i in range(16)], 8)).collect()]
    assert [int.from_bytes(b, "big") for b in got] == [int("aa" * 16, 16), 0x1FF]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 12), st.randoms())
def test_round_trip(dims, bits, rnd):
    pts = np.array([[rnd.randrange(1 << bits) for _ in range(dims)] for _ in range(8)], np.uint64)
    assert (decode_points(encode_points(pts, bits), dims, bits) == pts).all()


def test_neighbours_on_the_curve_touch():
    pts = decode_points(list(range(256)), 2, 4).astype(int)
    assert (np.abs(np.diff(pts, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=40, deadline=None)
@given(st.tuples(st.integers(0, 15), st.integers(0, 15), st.integers(0, 15), st.integers(0, 15)), st.integers(1, 40))
def test_ranges_cover_the_box(c, most):
    low, high = (min(c[0], c[1]), min(c[2], c[3])), (max(c[0], c[1]), max(c[2], c[3]))
    ranges = covering_ranges(low, high, 4, most)
    keys = {key_of((x, y), 4) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)}
    assert len(ranges) <= most
    assert all(any(a <= k <= b for a, b in ranges) for k in keys)
    if most == 40 and len(covering_ranges(low, high, 4, 256)) <= 40:
        assert sum(b - a + 1 for a, b in ranges) == len(keys)


def test_corner_interval_is_no_cover():
    assert key_of((2, 1), 8) > key_of((2, 2), 8)  # (2,1) lies in the box (1,1)-(2,2), outside [k(min), k(max)]


def test_key_limits():
    with pytest.raises(BadShape):
        key_of((1,) * 17, 8)
    key = CompositeKey(8)
    for i in range(16):
        key.push(str(i), F.lit(0))
    with pytest.raises(BadShape):
        key.push("17th", F.lit(0))


def test_quantize_keeps_order(spark):
    rows = spark.createDataFrame([(0,), (1 << 24,), (2**32 - 1,)], "c long").select(quantize(F.col("c"), 8)).collect()
    assert [r[0] for r in rows] == [0, 1, 255]


def test_ordinals(spark):
    ints = [-100, 0, 100, -42, 42, 2**31 - 1, -(2**31)]
    rows = spark.createDataFrame([(i,) for i in ints], "v int").select("v", ordinal.encode_i32(F.col("v")).alias("c")).withColumn("d", ordinal.decode_i32(F.col("c"))).collect()
    assert all(r["v"] == r["d"] for r in rows)
    assert sorted(ints) == [r["v"] for r in sorted(rows, key=lambda r: r["c"])]
    floats = [-1.0, 0.0, 1.0, 3.140000104904175, None, float("inf"), -(2.0**-100)]
    rows = spark.createDataFrame([(f,) for f in floats], "v float").select("v", ordinal.encode_f32(F.col("v")).alias("c")).withColumn("d", ordinal.decode_f32(F.col("c"))).collect()
    assert all(r["v"] == r["d"] for r in rows)
    known = [r for r in rows if r["v"] is not None]
    assert [r["v"] for r in sorted(known, key=lambda r: r["c"])] == sorted(f for f in floats if f is not None)
    assert ordinal.float_coords(np.array([-0.0, 0.0])).tolist() == [0x7FFFFFFF, 0x80000000]


def test_nan_is_an_error(spark):
    with pytest.raises(Exception, match="NaN"):
        spark.createDataFrame([(float("nan"),)], "v float").select(ordinal.encode_f32(F.col("v"))).collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), min_size=2))
def test_float_order(xs):
    c = ordinal.float_coords(np.array(xs, np.float32))
    for a, b, x, y in zip(c, c[1:], xs, xs[1:]):
        assert (a < b) if x < y else (a > b) if x > y else True


def fold(events):
    p = n = 0
    out = []
    for kind, *e in events:
        if kind == "tick":
            (now,) = e
            p, n = (now, 0) if now > p else (p, min(n + 1, 65535))
        else:
            rp, rl, now = e
            top = max(p, rp, now)
            n = min(max(n, rl) + 1 if top == p == rp else n + 1 if top == p else rl + 1 if top == rp else 0, 65535)
            p = top
        out.append((p, n))
    return out


def test_clock_sequences_equal_a_fold(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        ticks = [int(x) for x in rng.integers(0, 30, 60)]
        df = spark.createDataFrame([(0, i, t) for i, t in enumerate(ticks)], "node int, i int, now long")
        got = clock.tick_sequence(df, now="now", order=["i"], node=["node"]).orderBy("i").collect()
        assert [(r["physical_ms"], r["logical"]) for r in got] == fold([("tick", t) for t in ticks])
        rec = [(int(a) + 1, int(b), int(c) + 1) for a, b, c in zip(rng.integers(0, 30, 60), rng.integers(0, 5, 60), rng.integers(0, 30, 60))]
        df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rec)], "node int, i int, rp long, rl long, now long")
        got = clock.receive_sequence(df, remote_ms="rp", remote_logical="rl", now="now", order=["i"], node=["node"]).orderBy("i").collect()
        assert [(r["physical_ms"], r["logical"]) for r in got] == fold([("receive", *r) for r in rec])


def test_clock_packing(spark):
    r = spark.range(1).select(clock.pack(F.lit(1700000000000), F.lit(42)).alias("p")).select("p", clock.physical(F.col("p")), clock.logical(F.col("p")), clock.to_coord(F.col("p"))).first()
    assert r[1:] == (1700000000000, 42, 1700000000000 >> 16)
