"""Hand-made cases; the expected rows are written by hand."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import outliers as O
from tidemark.operators import ranks as K
from tidemark.operators import scan as N
from tidemark.operators import sliding as L
from tidemark.operators import tables as R
from tidemark.operators import temporal as T
from tidemark.plans import clinical as C
from tidemark.plans import cohorts as H
from tidemark.plans import statistics as X
from tidemark.sources import io
from tidemark.sources.shared import cut
from tidemark.sources.stages import manifest

ZERO = dt.datetime(2024, 5, 1)


def at(hours=0.0, seconds=0):
    return ZERO + dt.timedelta(hours=hours, seconds=seconds)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_asof(spark):
    left = spark.createDataFrame([(1, at()), (2, at()), (3, at()), (4, None), (None, at())], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(-72), "a"), (1, at(-72, -1), "b"), (1, at(24), "c"), (1, at(24, 1), "d"), (2, at(), "x"), (2, at(), "y"), (None, at(), "n"), (4, at(), "z")], "k int, u timestamp_ntz, v string")
    back = T.asof_join(left, right, ["k"], "t", "u", ["v"], hours=72)
    assert rows(back, "k", "r_u", "r_v") == sorted([(1, at(-72), "a"), (2, at(), "y"), (3, None, None), (4, None, None), (None, None, None)], key=repr)
    ahead = T.asof_join(left, right, ["k"], "t", "u", ["v"], forward=True, hours=24)
    assert rows(ahead, "k", "r_u", "r_v") == sorted([(1, at(24), "c"), (2, at(), "x"), (3, None, None), (4, None, None), (None, None, None)], key=repr)
    late = right.where("v in ('b', 'd')")
    assert rows(T.asof_join(left.where("k = 1"), late, ["k"], "t", "u", ["v"], hours=72), "r_v") == [(None,)]
    assert rows(T.asof_join(left.where("k = 1"), late, ["k"], "t", "u", ["v"], forward=True, hours=24), "r_v") == [(None,)]
    assert T.asof_join(left, right.limit(0), ["k"], "t", "u", ["v"]).where("r_v is not null").count() == 0 and T.asof_join(left.limit(0), right, ["k"], "t", "u", ["v"]).count() == 0


def test_asof_two_keys(spark):
    first = spark.createDataFrame([(1, "x", at(0)), (1, "y", at(0))], "k int, n string, t timestamp_ntz")
    last = spark.createDataFrame([(1, "x", at(5)), (1, "x", at(3)), (2, "y", at(1))], "k int, n string, u timestamp_ntz")
    assert rows(T.asof_join(first, last, ["k", "n"], "t", "u", [], forward=True), "n", "r_u") == [("x", at(3)), ("y", None)]


@pytest.mark.parametrize("bucket", [True, False])
def test_band(spark, bucket):
    left = spark.createDataFrame([(1, at()), (2, at()), (None, at())], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(-6), "on"), (1, at(48), "end"), (1, at(-6, -1), "out"), (1, at(48, 1), "out"), (None, at(), "null")], "k int, u timestamp_ntz, v string")
    assert rows(T.band_join(left, right, ["k"], "t", "u", 6, 48, bucket), "k", "v") == [(1, "end"), (1, "on")]


def test_lookback(spark):
    line = spark.createDataFrame([(1, at(8))], "k int, t timestamp_ntz")
    e = lambda *r: spark.createDataFrame([(1, t, "g", v) for t, v in r] + [(None, at(8), "g", 99.0)], "k int, t timestamp_ntz, g string, v double")
    feats = {f"f_{a}": ("g", a, 8) for a in ("last", "first", "max", "count")}
    got = lambda *r: rows(T.lookback(line, e(*r), "k", "t", "g", "v", feats), *feats)
    assert got((at(0), 1.0), (at(0, -1), 50.0), (at(8), 3.0)) == [(3.0, 1.0, 3.0, 2)]
    assert got((at(2), 7.0), (at(7), None)) == [(None, 7.0, 7.0, 1)]
    assert got((at(7), 4.0), (at(7), 5.0)) == [(5.0, 4.0, 5.0, 2)]
    assert got((at(9), 4.0)) == [(None, None, None, 0)]


def test_expiring_fill(spark):
    data = [(1, "p", at(0), None), (2, "p", at(1), 5.0), (3, "q", at(2), 9.0), (4, "p", at(9), None), (5, "p", at(9, 1), None), (6, "q", at(3), None), (7, "o", at(1), 2.0), (8, "o", at(2), None)]
    df = spark.createDataFrame([(i, "k", g, t, v) for i, g, t, v in data], "i int, k string, g string, t timestamp_ntz, v double")
    out = T.fill_expiring(df, ["k"], "g", "t", "v", "f", {"p": 8, "q": 12})
    assert rows(out, "i", "f") == [(1, None), (2, 5.0), (3, 9.0), (4, 5.0), (5, None), (6, 9.0), (7, 2.0), (8, None)]


def test_fills_within_an_instant(spark):
    df = spark.createDataFrame([(1, at(0), None), (2, at(0), 4.0), (3, at(1), None), (4, at(2), 8.0), (5, at(2), 7.0)], "i int, t timestamp_ntz, v double").withColumn("k", F.lit(1))
    assert rows(T.fill_forward(df, ["k"], "t", "v", "f"), "i", "f") == [(1, 4.0), (2, 4.0), (3, 4.0), (4, 8.0), (5, 7.0)]
    assert rows(T.fill_forward(df, ["k"], "t", "v", "f", backward=True), "i", "f") == [(1, 4.0), (2, 4.0), (3, 7.0), (4, 8.0), (5, 7.0)]
    assert rows(T.fill_nearest(df, ["k"], "t", "v", "f", 2), "i", "f")[2] == (3, 4.0)


def test_long_keys(spark):
    """Dealt by time buckets, joins, fills and spells give the rows of one window over each key: nulls and ties too."""
    r = np.random.default_rng(8)
    data = [(int(i), [None, 1, 2][k], [None, at(seconds=600 * int(t))][min(1, int(u * 30))], None if n < 0.3 else float(v)) for i, (k, t, u, n, v) in enumerate(zip(r.integers(0, 3, 400), r.integers(0, 60, 400), r.random(400), r.random(400), r.integers(0, 4, 400), strict=True))]
    df = cut(spark.createDataFrame(data, "i int, k int, t timestamp_ntz, v double"))
    other = df.where("i % 3 = 0").select("k", F.col("t").alias("s"), "v", F.col("i").alias("j"))
    same = lambda f: [sorted(map(repr, f(b).collect())) for b in (None, 1.0, 0.1, 500.0)]
    for forward in (False, True):
        a = same(lambda b, f=forward: T.asof_join(df, other, ["k"], "t", "s", ["v", "j"], f, 4, b))
        assert len(a[0]) == 400 and all(x == a[0] for x in a)
        for tie in ([], ["i"]):
            a = same(lambda b, f=forward, x=tie: T.fill_forward(df, ["k"], "t", "v", "f", 2, f, x, b).select("k", "t", "v", "f", *x))
            assert len(a[0]) == 400 and all(x == a[0] for x in a)
    a = same(lambda b: T.fill_nearest(df, ["k"], "t", "v", "f", 3, ["i"], b))
    assert all(x == a[0] for x in a)
    for f in (T.spells, T.run_durations):
        a = same(lambda b, f=f: f(df, ["k"], "t", "v", bucket=b).select("k", "spell", "v", "start", "end", "n", "hours"))
        assert len(a[0]) > 100 and all(x == a[0] for x in a)


def test_neighbours_of_long_keys(spark):
    """Dealt by time buckets that borrow rows at their ends, the operators on neighbouring rows give those of one window over each key."""
    r = np.random.default_rng(12)
    data = [(int(i), [None, 1, 2][k], [None, at(seconds=600 * int(t))][min(1, int(u * 30))], None if n < 0.2 else float(v), "ab"[int(v) % 2]) for i, (k, t, u, n, v) in enumerate(zip(r.integers(0, 3, 300), r.integers(0, 90, 300), r.random(300), r.random(300), r.integers(0, 6, 300), strict=True))]
    df = cut(spark.createDataFrame(data, "i int, k int, t timestamp_ntz, v double, s string"))
    iv = df.where("k is not null and t is not null").groupBy("k", "t").agg(F.max("v").alias("v"), F.max("s").alias("s")).withColumn("e", S.plus_hours("t", 3))
    a, b = iv.where("s = 'a'"), iv.where("s = 'b'")
    on, off = F.col("v") >= 4, F.col("v") < 2
    cases = {
        "velocity": lambda x: O.velocity_flags(df, ["k"], "t", "v", 0.01, 2, 60, ["i"], x),
        "context": lambda x: O.context(df, ["k"], "t", "v", 3, ["i"], x),
        "neighbours": lambda x: O.neighbours(df, ["k"], "t", "v", 10, ["i"], x),
        "shifted": lambda x: T.shifted(df, ["k"], "t", {"p": ("i", -2), "n": ("v", 7)}, ["i"], x),
        "sojourns": lambda x: T.sojourns(df, ["k"], "t", "s", x),
        "transitions": lambda x: T.transitions(df, ["k"], "t", "s", True, x),
        "path": lambda x: T.path_edges(df, ["k"], "t", "s", bucket=x),
        "episodes": lambda x: T.episodes(df, ["k"], "t", on, off, x),
        "thin": lambda x: T.thin(df, ["k"], "t", 0.3, ["i"], x),
        "bridged": lambda x: T.bridged_spells(df, ["k"], "t", "s", 0.5, x).select("k", "spell", "s", "start", "end", "n", "hours"),
        "segment": lambda x: T.segment(a, b, ["k"], "t", "e", "v", x),
        "lookup": lambda x: T.interval_lookup(df, iv.select("k", F.col("t").alias("st"), "e", F.col("v").alias("w")), ["k"], "t", "st", "e", ["w"], x),
        "running": lambda x: N.running_sum(df, ["k"], "t", ["t", "i"], F.col("v"), "sum", x),
        "courses": lambda x: H.courses(df, ["k"], "t", on, off, x),
        "gaps": lambda x: H.state_gaps(df.withColumn("e", S.plus_hours("t", 1.0)).withColumn("e", F.when(on, F.col("e")).otherwise(F.col("t"))), ["k"], "t", "e", "s", 0.5, x),
        "combined": lambda x: H.combined_states(T.segment(a, b, ["k"], "t", "e", "v"), ["k"], "seg_start", "seg_end", "a_state", "b_state", x).withColumn("hours", F.round("hours", 6)),
        "changes": lambda x: H.state_transitions(H.combined_states(T.segment(a, b, ["k"], "t", "e", "v"), ["k"], "seg_start", "seg_end", "a_state", "b_state"), ["k"], x).withColumn("mean_hours", F.round("mean_hours", 6)).withColumn("total_hours", F.round("total_hours", 6)),
    }
    for name, f in cases.items():
        plain = f(None)
        want = sorted(map(repr, plain.collect()))
        assert want, name
        for hours in (0.4, 500.0) if name in ("shifted", "running", "gaps") else (0.4,):
            got = f(hours)
            assert got.columns == plain.columns and dict(got.dtypes) == dict(plain.dtypes), (name, got.dtypes, plain.dtypes)
            assert sorted(map(repr, got.collect())) == want, (name, hours)


def test_neighbours_by_hand(spark):
    """Buckets of an hour with one, no and many rows: the rows on either side come from whichever bucket has them."""
    hours = [0, 0.2, 5, 6.5, 6.6, 6.7, 30]
    df = spark.createDataFrame([(1, at(seconds=round(3600 * h)), float(i)) for i, h in enumerate(hours)] + [(2, at(1), 9.0)], "k int, t timestamp_ntz, v double")
    out = T.shifted(df, ["k"], "t", {"back": ("v", -3), "on": ("v", 2)}, bucket=1.0)
    assert rows(out, "k", "v", "back", "on") == sorted([(1, float(i), i - 3.0 if i >= 3 else None, i + 2.0 if i < 5 else None) for i in range(7)] + [(2, 9.0, None, None)], key=repr)
    total = N.running_sum(df, ["k"], "t", ["t"], F.col("v"), "s", 1.0)
    assert rows(total, "k", "v", "s") == sorted([(1, float(i), float(sum(range(i + 1)))) for i in range(7)] + [(2, 9.0, 9.0)], key=repr)
    one = R.with_group(df.unionByName(spark.createDataFrame([(None, None, 4.0)], df.schema)), ["k"], {"top": F.max("v")})
    assert rows(one.select("k", "top").distinct(), "k", "top") == sorted([(1, 6.0), (2, 9.0), (None, 4.0)], key=repr)


def test_rolling_over_buckets(spark):
    r = np.random.default_rng(3)
    t = r.integers(0, 4_000, 250)
    data = [("k", i, at(seconds=60 * int(x)), float(i)) for i, x in enumerate(t)] + [("k", 900, None, 5.0), ("k", 901, None, 6.0), (None, 902, at(0), 1.0)]
    df = spark.createDataFrame(data, "k string, i int, t timestamp_ntz, v double")
    for before, after, closed in ((2, 0, False), (1.5, 3, False), (2, 0, True), (0, 0, False)):
        out = {x.i: x.s for x in T.rolling(df, ["k"], "t", {"s": F.sum("v")}, before, after, closed).collect()}
        assert len(out) == 253 and out[900] == out[901] == 11.0 and out[902] == (None if closed else 1.0)
        for i, x in enumerate(t):
            inside = (t >= x - 60 * before) & ((t < x) if closed else (t <= x + 60 * after))
            assert out[i] == (float(np.flatnonzero(inside).sum()) if inside.any() else None)


def test_latest_values_of_a_dense_key(spark):
    """A look-back for the latest value costs the same however many readings its window holds: here up to 200,000."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 100_000).cast("timestamp_ntz").alias("t"), F.when(F.col("id") % 1000 == 0, "a").when(F.col("id") < 10, "b").otherwise("c").alias("g"), F.col("id").cast("double").alias("v"))
    out = T.lookback(df, df, "k", "t", "g", "v", {"a": ("a", "last", 24), "a_min": ("a", "last", 1 / 60), "b": ("b", "last", 1), "c": ("c", "last", 24)})
    got = out.withColumn("i", F.round((S.micros("t") / 100_000)).cast("long"))
    a = F.col("i") - F.col("i") % 1000
    c = F.when(F.col("i") % 1000 == 0, F.col("i") - 1).otherwise(F.col("i"))
    want = [F.col("a") == a, F.col("a_min").eqNullSafe(F.when(F.col("i") % 1000 <= 600, a)), F.col("b").eqNullSafe(F.when(F.col("i") == 0, None).when(F.col("i") < 10, F.col("i")).when(F.col("i") <= 36_009, 9)), F.col("c").eqNullSafe(F.when(F.col("i") >= 10, c))]
    assert got.count() == 200_000 and [got.where(~w).count() for w in want] == [0, 0, 0, 0]


def test_neighbours_are_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), "id")
    out = T.shifted(df, ["k"], "t", {"p": ("id", -1), "n": ("id", 3)}, bucket=N.bucket_hours(df, ["k"], "t", 10_000))
    per = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.col("p") != F.col("id") - 1).alias("x"), F.count_if(F.col("n") != F.col("id") + 3).alias("y"), F.count_if(F.col("p").isNull()).alias("z"), F.count_if(F.col("n").isNull()).alias("e")).collect()
    assert len(per) >= 4 and max(x.n for x in per) < 500_000 and sum(x.n for x in per) == 1_000_000
    assert [sum(x[c] for x in per) for c in ("x", "y", "z", "e")] == [0, 0, 1, 3]


def test_a_long_key_is_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"), (F.col("id") % 5000 < 2500).alias("s"))
    hours = N.bucket_hours(df, ["k"], "t", 10_000)
    assert 2 < hours < 4 and N.bucket_hours(df, ["k"], "t") is None
    out = T.fill_forward(df, ["k"], "t", "v", "f", bucket=hours)
    per = out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("f").alias("f")).collect()
    assert len(per) >= 4 and max(x.n for x in per) < 500_000
    assert sum(x.f for x in per) == sum(1000 * x for x in range(0, 1_000_000, 1000))
    runs = T.run_durations(df, ["k"], "t", "s", hours)
    assert rows(runs.agg(F.count("*").alias("n"), F.sum("n").alias("m"), F.max("spell").alias("s"), F.count_if("censored").alias("c")), "n", "m", "s", "c") == [(400, 1_000_000, 400, 1)]


def test_backward_fill_is_linear(spark):
    def took(n):
        df = spark.range(n).select(F.lit(1).alias("k"), (F.timestamp_seconds("id").cast("timestamp_ntz")).alias("t"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v"))
        began = time.time()
        got = T.fill_forward(df, ["k"], "t", "v", "f", backward=True).agg(F.sum("f"), F.count("f")).first()
        assert got[1] == n and got[0] == sum(1000 * x for x in range(999, n, 1000))
        return time.time() - began

    took(1000)
    assert took(1_000_000) < 60  # quadratic: hours


def test_bounds_and_mad(spark):
    df = spark.createDataFrame([("g", 5.0), ("g", 4.9), ("g", 60.0), ("g", 60.1), ("o", 99.0), ("g", None)], "g string, v double")
    assert rows(df.select(O.bounded("g", "v", {"g": (5, 60)}).alias("v")), "v") == sorted([(5.0,), (None,), (60.0,), (None,), (99.0,), (None,)], key=repr)
    lim = spark.createDataFrame([("g", 5.0, 60.0)], "g string, lo double, hi double")
    assert rows(O.against_bounds(df, lim, "g", "v", "lo", "hi"), "v", "outside") == sorted([(5.0, False), (4.9, True), (60.0, False), (60.1, True), (None, None)], key=repr)
    four = [("a", i, at(i), 1.0 if i else 50.0) for i in range(4)]
    same = [("b", 10 + i, at(i), 7.0) for i in range(6)]
    spike = [("c", 20 + i, at(i), 300.0 if i == 3 else 70.0 + i) for i in range(7)]
    lone = [("d", 30 + i, at(20 * i), float(i * 100)) for i in range(6)]
    # the others of row 45 are 1 to 5, median 3, deviation 1: 3 * 1.4826 = 4.4478 is the limit
    between = [("e", 41 + i, at(i), float(i + 1)) for i in range(5)]
    m = spark.createDataFrame(four + same + spike + lone, "k string, i int, t timestamp_ntz, v double")
    assert rows(O.mad_outliers(m, ["k"], "t", "v").where("outlier"), "i") == [(23,)]
    for v, out in ((7.4477, []), (7.4479, [(46,)]), (6.0, [])):
        m = spark.createDataFrame([*between, ("e", 46, at(2), v)], "k string, i int, t timestamp_ntz, v double")
        assert rows(O.mad_outliers(m, ["k"], "t", "v").where("outlier"), "i") == out


def test_velocity_within_an_instant(spark):
    data = [(1, at(0), 5.0), (2, at(0), 5.4), (3, at(0), 30.0), (4, at(1), 31.0), (5, at(60), 90.0), (6, at(60, 2), 95.0)]
    df = spark.createDataFrame([("k", *r) for r in data], "k string, i int, t timestamp_ntz, v double")
    out = O.velocity_flags(df, ["k"], "t", "v", 2, 20, 1440)
    # 0.4 over 10^-6 minutes is fast, 24.6 is no velocity but far; 59 hours before aren't recent
    assert rows(out, "i", "too_fast", "too_far") == [(1, False, False), (2, True, False), (3, False, True), (4, False, False), (5, False, False), (6, True, False)]


def test_window_ends(spark):
    df = spark.createDataFrame([("k", i, at(i), float(10**i)) for i in range(6)], "k string, i int, t timestamp_ntz, v double")
    # two hours before a reading is outside, two hours after inside
    med = {r.i: r.med for r in O.robust_z(df, ["k"], "t", "v", 2, 2).collect()}
    assert med == {0: 10.0, 1: 55.0, 2: 550.0, 3: 5500.0, 4: 10_000.0, 5: 55_000.0}


def test_order_statistics():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 300):
        x = np.where(r.random(n) < 0.1, np.nan, r.integers(0, 9, n).astype(float))
        lo = np.maximum.accumulate(np.clip(np.arange(n) - r.integers(0, 9, n), 0, None))
        hi = np.clip(np.maximum.accumulate(np.arange(n) + r.integers(1, 9, n)), None, n)
        plain = lambda f, y: f(y) if len(y) else np.nan
        parts = [x[a:b][~np.isnan(x[a:b])] for a, b in zip(lo, hi, strict=True)]
        assert L.sliding_median(x, lo, hi) == pytest.approx([plain(np.median, y) for y in parts], nan_ok=True)
        assert L.sliding_deviation(x, lo, hi) == pytest.approx([np.std(y, ddof=1) if len(y) > 1 else np.nan for y in parts], nan_ok=True, abs=1e-9)
        others = [np.r_[x[a:i], x[i + 1 : b]] for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
        others = [y[~np.isnan(y)] if x[i] == x[i] else y[:0] for i, y in enumerate(others)]
        others = [y if len(y) >= 2 else y[:0] for y in others]
        med, mad = L.median_of_others(x, lo, hi, 2)
        assert med == pytest.approx([plain(np.median, y) for y in others], nan_ok=True)
        assert mad == pytest.approx([plain(lambda y: np.median(np.abs(y - np.median(y))), y) for y in others], nan_ok=True)


def test_dense_windows_are_linear(spark):
    """100,000 readings within one window of eight hours; quadratic work would take hours."""
    def took(n):
        df = spark.range(n).selectExpr("'k' AS k", "timestampadd(MICROSECOND, id * 100000, timestamp_ntz'2024-01-01 00:00:00') AS t", "double(if(id % 1000 = 7, 500, id % 13)) AS v")
        began = time.time()
        flagged = O.mad_outliers(df, ["k"], "t", "v").where("outlier").count()
        z = O.robust_z(df, ["k"], "t", "v", 2.5, 2.5).where("abs(robust_z) > 9").count()
        assert flagged == z == n // 1000
        return time.time() - began

    took(1_000)
    assert took(100_000) < 60


def test_settings_by_group(spark):
    """One scan and one shuffle for any number of groups, and the rows of each group alone."""
    kinds = {f"g{i}": (6.0 + i, 0.5, 1.2) for i in range(9)}
    data = [(f"k{i % 3}", f"g{i % 10}", at(seconds=977 * i), float((i * 7919) % 101)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, g string, t timestamp_ntz, v double")
    df = cut(df)
    table = spark.createDataFrame([(g, *x) for g, x in kinds.items()], "g string, hours double, floor double, limit double")
    out = O.rolling_z_by_group(df, ["k"], "t", "v", "g", table)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # the readings with a time and those without
    assert plan.count("parquet") == 2 and plan.count("RepartitionByExpression") == 1
    got = sorted(map(repr, out.collect()))
    alone = [O.rolling_z(df.where(F.col("g") == g), ["k"], "t", "v", h, f).withColumn("outlier", F.abs("z") > x) for g, (h, f, x) in kinds.items()]
    want = sorted(repr(r) for d in alone for r in d.withColumn("outlier", F.coalesce("outlier", F.lit(False))).collect())
    assert got == want and len(got) == 540
    assert sorted(map(repr, O.rolling_z_by_group(df, ["k"], "t", "v", "g", kinds).collect())) == got


def test_windows_across_buckets(spark):
    r = np.random.default_rng(5)
    t, v = np.sort(r.integers(0, 3_000, 300)), r.normal(50, 9, 300)
    df = spark.createDataFrame([(1, at(seconds=60 * int(a)), None if i % 17 == 0 else float(b), i) for i, (a, b) in enumerate(zip(t, v, strict=True))] + [(1, None, 1.0, 999)], "k int, t timestamp_ntz, v double, i int")
    v = np.where(np.arange(300) % 17 == 0, np.nan, v)
    inside = [np.flatnonzero((t - a > -150) & (t - a <= 150)) for a in t]
    med = np.array([np.nanmedian(v[w]) for w in inside])
    mad = np.array([1.4826 * np.nanmedian(np.abs(v - med)[w]) for w in inside])
    got = {x.i: x for x in O.robust_z(df, ["k"], "t", "v", 2.5, 2.5).collect()}
    assert len(got) == 301 and got[999].robust_z is None
    for i in range(300):
        assert got[i].med == pytest.approx(med[i]) and got[i].mad == pytest.approx(mad[i]), i
        assert got[i].robust_z is None if np.isnan(v[i]) else got[i].robust_z == pytest.approx((v[i] - med[i]) / mad[i])
    clean, gone = O.split_outliers(df, ["k"], "t", "v", hours=2.5)
    assert clean.count() + gone.count() == 301 and clean.columns == df.columns


def test_pressure_text(spark):
    texts = ["120/80", " 120 / 80 ", "120", "abc/80", "80/120", "0/0", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.mean_arterial(F.col("t")).alias("m"), S.systolic(F.col("t")).alias("s"))
    assert rows(df, "i", "m", "s") == [(0, 93.3, 120.0), (1, 93.3, 120.0), (2, None, 120.0), (3, None, None), (4, None, 80.0), (5, None, 0.0), (6, None, None)]
    e = spark.createDataFrame([(1, at(0), "Blood Pressure", "120/80", None), (1, at(1), "Blood Pressure", "x", None), (1, at(2), "Pulse", None, 80.0), (1, at(3), "Pulse", None, None)], "k int, t timestamp_ntz, g string, x string, n double")
    c = C.Columns(key="k", ts="t", group="g", text="x", number="n")
    assert rows(C.pressures(e, c), "t", "g", "n") == sorted([(at(0), "Systolic Blood Pressure", 120.0), (at(0), "Arterial Blood Pressure Mean", 93.3), (at(1), "Arterial Blood Pressure Mean", None), (at(2), "Pulse", 80.0)], key=repr)
    f = e.withColumn("kind", F.lit("Flowsheet"))
    assert rows(C.number_from_pressure(f, C.Columns(key="k", ts="t", group="g", text="x", number="n", kind="kind")), "n") == sorted([(120.0,), (None,), (80.0,), (None,)], key=repr)


def test_flag_thresholds(spark):
    cols = "last_temp_8h double, last_pulse_8h double, last_resp_8h double, last_wbc_12h double"
    df = spark.createDataFrame([(96.8, 90.0, 20.0, 4.0), (100.4, 90.0, 20.0, 12.0), (96.7, 91.0, 21.0, 3.9), (100.5, 90.0, 20.0, 12.1), (None, None, None, None)], cols)
    assert [r.sirs_score for r in C.sirs(df).collect()] == [0, 0, 4, 2, 0]
    kind = ", ".join(f"{c} double" for c in ("last_sbp_8h", "Baseline_SBP", "last_map_8h", "last_lactate_6h", "last_vasopressin_24h", "last_phenylephrine_24h", "last_norepinephrine_24h", "last_epinephrine_24h"))
    shock = spark.createDataFrame([(89.0, None, 65.0, 4.0, None, None, None, None), (90.0, None, 65.0, 4.0, None, None, None, None), (79.0, 119.0, 65.0, 4.0, 0.0, None, None, None), (78.0, 119.0, 65.0, 4.0, 0.0, None, None, None), (100.0, 110.0, 64.0, None, None, None, None, None), (100.0, 110.0, 66.0, 1.0, None, None, 0.1, None)], kind)
    assert [r.septic_shock_flag for r in C.septic_shock(shock).collect()] == [1, 0, 0, 1, 1, 1]
    assert [r.septic_shock_flag for r in C.septic_shock(shock, "propagate").collect()][4] == 0  # lactate null hides the low MAP


VC = C.Columns(key="k", ts="t", group="g", name="n", text="x", number="v")


def _vent(spark, data):
    return spark.createDataFrame([(k, at(h), g, n, x, v) for k, h, g, n, x, v in data], "k int, t timestamp_ntz, g string, n string, x string, v double")


def test_ventilation(spark):
    on, doc, mech = "Vent On/Off", "Vent On Documentation", "O2 Delivery Mechanical Ventilation"
    e = _vent(spark, [
        (1, 0, on, "a", "Initial", None), (1, 1, on, "a", "On Going Hospital Vent", None), (1, 2, on, "a", "$ On Going Hospital Vent", None), (1, 3, on, "a", "Standby", None), (1, 4, on, "a", None, None), (1, 5, on, "a", "On", None), (1, 5.5, on, "a", "Off", None),
        (1, 6, doc, "b", None, None), (1, 7, doc, "b", "Standby", None), (1, 8, "Vent Off Documentation", "c", "x", None),
        (1, 9, mech, "d", "CPAP", None), (1, 10, mech, "d", "Mask", None), (1, 11, "O2 Delivery Nasal Cannula", "e", "any", None), (1, 12, "O2 Delivery", "e", "Room air", None),
        (2, 0, on, "a", "$ Home Vent Used", None), (2, 1, on, "a", "Initial", None), (3, 0, "Diagnosis", "dx", "Z99.11", None), (3, 1, doc, "b", None, None),
    ])
    got = {(r.k, (r.t - ZERO).total_seconds() / 3600): r.pulmonary_dysfunction_flag for r in C.pulmonary(e, VC).collect()}
    assert got == {(1, 0.0): 1, (1, 1.0): 1, (1, 2.0): 1, (1, 3.0): 0, (1, 4.0): 0, (1, 5.0): None, (1, 5.5): None, (1, 6.0): 1, (1, 7.0): 1, (1, 8.0): 0, (1, 9.0): 1, (1, 10.0): None, (1, 11.0): 0, (1, 12.0): None}


def test_pf_ratio(spark):
    e = _vent(spark, [(1, 0, "PAO2", "p", None, 100.0), (1, 1.999, "FIO2", "f", None, 50.0), (1, -2, "FIO2", "f", None, 20.0), (2, 0, "PAO2", "p", None, 99.0), (2, 1, "FIO2", "f", None, 50.0), (3, 0, "PAO2", "p", None, 101.0), (3, 1, "FIO2", "f", None, 50.0), (4, 0, "PAO2", "p", None, 80.0), (4, 0, "FIO2", "f", None, 0.0)])
    got = rows(C.pulmonary(e, VC).where("g = 'PAO2'"), "k", "pf_ratio", "pulmonary_dysfunction_flag")
    assert got == [(1, 200.0, None), (2, 198.0, 1), (3, 202.0, 0), (4, float("inf"), 0)]


def test_highest_poa(spark, monkeypatch):
    first = spark.createDataFrame([(1, at(1), None), (1, at(0), at(9)), (2, at(2), None), (3, None, None), (4, at(1), None), (5, None, at(3)), (None, at(0), at(0)), (7, at(0), None)], "k int, s1 timestamp_ntz, s2 timestamp_ntz")
    enc = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(0)), (4, None), (5, at(-9)), (5, at(1)), (None, at(0)), (6, at(0))], "k int, a timestamp_ntz")
    want = [(1, "NPOA-2"), (2, "POA-1"), (4, "NPOA-1"), (5, "POA-2")]
    assert rows(H.highest_poa(first, enc, "k", {1: "s1", 2: "s2"}, "a", 2, "l"), "k", "l") == want
    # dealt by the number of rows
    monkeypatch.setattr(H, "spread", lambda frames, keys: R.spread(frames, keys, rows=1))
    many = first.crossJoin(spark.range(3).select()).cache()
    got = H.highest_poa(many, enc, "k", {1: "s1", 2: "s2"}, "a", 2, "l")
    assert rows(got, "k", "l") == want and [d.rdd.getNumPartitions() for d in R.spread([many, enc], ["k"], 2)] == [12, 12]
    assert [d.rdd.getNumPartitions() for d in R.spread([enc], ["k"], 8)] == [enc.rdd.getNumPartitions()]


def test_pf_ratio_of_zeros(spark, tmp_path):
    """Zeros, signs and nulls divide as they do in the query's SQL."""
    import duckdb

    from tidemark.plans import queries as Q

    pairs = [(0.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (5.0, 0.0), (0.0, 20.0), (None, 0.0), (7.0, None), (1.0, 5e-324), (1.0, 50.0)]
    data = [(k, at(h), kind, v) for k, (p, q) in enumerate(pairs) for h, kind, v in ((0, "view", p), (1, "error", q))]
    spark.createDataFrame(data, "user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = rows(Q.pulmonary_flags(spark, f"file://{tmp_path}").where("grp = 'PAO2'"), "user_id", "pf_ratio", "pulmonary_dysfunction_flag")
    inf, nan = float("inf"), float("nan")
    assert repr(got) == repr([(0, nan, 0), (1, -inf, 1), (2, -inf, 1), (3, inf, 0), (4, 0.0, 1), (5, None, None), (6, None, None), (7, inf, 0), (8, 2.0, 1)])
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = c.sql(f"SELECT user_id, pf_ratio, pulmonary_dysfunction_flag FROM ({Q.SQL['pulmonary_flags']}) WHERE grp = 'PAO2' ORDER BY 1").fetchall()
    assert repr(got) == repr(want)


def test_long_infections(spark):
    e = spark.createDataFrame([(1, at(0), "IV Antibiotics - First", "Antibiotics", None), (1, at(20), "P", "Blood Culture Order", None), (1, at(24), "L", "Lactate", None), (1, at(30), "O", "Code Sepsis Page", None), (1, at(31), "F", "Suspected Infection", "Yes"), (1, at(32), "F", "Suspected Infection", "yes"), (2, at(0), "P", "Blood Culture Order", None)], "EncounterEpicCsn int, Event_DateTime timestamp_ntz, Type string, Event_Grouper string, Value string")
    long = C.infections(e, C.Scenario())
    assert rows(long, "criterion", "infect_dt", "suspicion_infection_type") == sorted([
        ("iv_dt", at(0), "IV+Culture"), ("culture_dt", at(20), "IV+Culture"), ("culture_dt", at(20), "LACTATE+CULTURE"), ("lactate_dt", at(24), "LACTATE+CULTURE"),
        ("first_ev_time_codesepsis", at(30), "CODE_SEPSIS_ORDER"), ("first_ev_time_flowsheet", at(31), "FLOWSHEET_SUSPECTED_INFECTION")], key=repr)
    assert rows(C.infections_wide(long, "EncounterEpicCsn"), "infection_time", "first_ev_type", "infection_ev_type") == [(at(0), "antibiotic_culture", "antibiotic_culture__lactate_culture__sepsis_diagnosis_code__suspected_infection_flowsheet")]


def test_roll_up(spark):
    stack = spark.createDataFrame([(1, 1, at(0)), (1, 3, at(9)), (2, 1, at(4)), (2, 2, at(4))], "k int, score int, instant timestamp_ntz")
    assert rows(C.severities(stack, "k"), "k", "first_sepsis_instant", "sepsis_score", "sepsis_score_at_max", "first_sepsis_instant_at_max") == [(1, at(0), 1, 3, at(9)), (2, at(4), 2, 2, at(4))]
    assert rows(R.at_maximum(stack, ["k"], "instant"), "k", "score") == [(1, 3), (2, 1), (2, 2)]


def test_poa(spark):
    df = spark.createDataFrame([(1, at(48), at(0)), (2, at(48, 1), at(0)), (3, at(1), None), (4, None, at(0))], "k int, f timestamp_ntz, a timestamp_ntz").select("k", C.poa("f", "a", 48, F.lit(2)).alias("p"))
    assert rows(df, "k", "p") == [(1, "POA-2"), (2, "NPOA-2"), (3, "NPOA-2"), (4, "NPOA-2")]


def test_spells(spark):
    one = spark.createDataFrame([(1, at(0), "a")], "k int, t timestamp_ntz, s string")
    assert rows(T.spells(one, ["k"], "t", "s"), "spell", "s", "start", "end", "n", "hours") == [(1, "a", at(0), at(0), 1, 0.0)]
    tie = spark.createDataFrame([(1, at(0), "b"), (1, at(0), "a"), (1, at(1), "b")], "k int, t timestamp_ntz, s string")
    assert rows(T.spells(tie, ["k"], "t", "s"), "spell", "s", "n") == [(1, "a", 1), (2, "b", 2)]
    for minutes, n in ((14, 1), (15, 3)):
        d = spark.createDataFrame([(1, at(0), "a"), (1, at(1), "b"), (1, at(1, 60 * minutes), "b"), (1, at(2), "a")], "k int, t timestamp_ntz, s string")
        assert T.bridged_spells(d, ["k"], "t", "s", 0.25).count() == n


def test_segments(spark):
    iv = lambda *r: spark.createDataFrame([(1, at(a), None if b is None else at(b), s) for a, b, s in r], "k int, s timestamp_ntz, e timestamp_ntz, v string")
    seg = lambda a, b: rows(T.segment(a, b, ["k"], "s", "e", "v"), "seg_start", "seg_end", "a_state", "b_state")
    assert seg(iv((0, 1, "x")), iv((2, 3, "y"))) == [(at(0), at(1), "x", None), (at(1), at(2), None, None), (at(2), at(3), None, "y")]
    assert seg(iv((0, 4, "x")), iv((1, 2, "y"))) == [(at(0), at(1), "x", None), (at(1), at(2), "x", "y"), (at(2), at(4), "x", None)]
    assert seg(iv((0, 1, "x")), iv((1, 2, "y"))) == [(at(0), at(1), "x", None), (at(1), at(2), None, "y")]
    assert seg(iv((0, None, "x")), iv((1, 2, "y"))) == [(at(0), at(1), "x", None), (at(1), at(2), "x", "y")]


def test_overlaps(spark):
    df = spark.createDataFrame([(1, at(0), at(4), at(1), at(2)), (2, at(1), at(2), at(0), at(4)), (3, at(0), at(2), at(1), at(3)), (4, at(1), at(3), at(0), at(2)), (5, at(0), at(1), at(1), at(2))], "i int, a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, d timestamp_ntz")
    assert rows(df.select("i", H.overlap_pattern("a", "b", "c", "d").alias("p")), "i", "p") == [(1, "a_contains_b"), (2, "b_contains_a"), (3, "a_first_b_last"), (4, "b_first_a_last"), (5, None)]


def test_agreement(spark):
    df = lambda *r: spark.createDataFrame(list(r), "a int, b int")
    same = X.agreement(df((1, 1), (2, 2), (3, 3)), "a", "b").first()
    assert (same.exact, same.kappa) == (1.0, 1.0)
    apart = X.agreement(df((1, 2), (1, 3)), "a", "b").first()
    assert (apart.exact, apart.upgraded, apart.downgraded, apart.kappa) == (0.0, 1.0, 0.0, 0.0)
    assert X.agreement(df((1, 1), (1, 1)), "a", "b").first().kappa is None
    ids = lambda *r: spark.createDataFrame([(x,) for x in r], "k int")
    o = X.overlap(ids(1, 2, 2), ids(3), "k").first()
    assert (o.only_a, o.only_b, o.both, o.either, o.jaccard) == (2, 1, 0, 3, 0.0)


def test_known_statistics(spark):
    assert X.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert X.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert X.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    odds, p = X.fisher_exact(8, 2, 1, 5)
    assert odds == 20 and p == pytest.approx(0.034965034965, abs=1e-9)
    assert X.fisher_exact(3, 1, 1, 3)[1] == pytest.approx(34 / 70)
    assert X.fisher_exact(1, 1_000_000, 2, 3_000_000)[1] <= 1
    two = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 5.0, 6.0, 6.0)], "g string, v double")
    m = X.mann_whitney(two, "g", "v").first()
    # U = 0; mean 6, variance 12 / 12 * (8 - 6 / 42)
    assert m.u == 0 and m.z == pytest.approx(5.5 / (8 - 6 / 42) ** 0.5) and m.p == pytest.approx(X.normal_tail(m.z))
    cells = [(1, "y")] * 20 + [(1, "n")] * 10 + [(0, "y")] * 15 + [(0, "n")] * 25
    f = spark.createDataFrame(cells, "f int, g string")
    yates = 70 * (abs(20 * 25 - 10 * 15) - 35) ** 2 / (30 * 40 * 35 * 35)
    t = X.factor_tests(f, ["f"], "g").first()
    assert t.chi2 == pytest.approx(yates) and t.dof == 1 and t.p == pytest.approx(X.chi_square_tail(yates, 1))
    b = X.binary_factors(f, ["f"], "g", "y").first()
    assert (b.a, b.b, b.c, b.d, b.test) == (20, 10, 15, 25, "Chi-square") and b.p == pytest.approx(t.p) and b.odds_ratio == pytest.approx(20 * 25 / 150)
    small = X.binary_factors(f.limit(25), ["f"], "g", "y").first()
    assert small.test == "Fisher's exact" and small.odds_ratio is None


def test_exact_quantiles(spark):
    r = np.random.default_rng(3)
    data = [(str(g), float(v)) for g, v in zip(r.integers(0, 4, 500), r.integers(0, 90, 500), strict=True)] + [(None, 5.0), (None, 7.0), ("0", None), ("z", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {x.g: (x.a, x.b) for x in K.quantiles(df, ["g"], "v", {"a": 0.37, "b": 0.9}).collect()}
    for g in {g for g, _ in data} - {"z"}:
        mine = [v for h, v in data if h == g and v is not None]
        assert got[g] == pytest.approx((np.quantile(mine, 0.37), np.quantile(mine, 0.9)))
    assert K.quantiles(df.limit(0), [], "v", {"a": 0.5}).first().a is None
    up = K.running(spark.createDataFrame([(i, 1) for i in range(300)], "i int, n int").repartition(7), [F.desc("i")], "n", "s")
    assert rows(up, "i", "s") == sorted(((i, 300 - i) for i in range(300)), key=repr)


def test_classifiers(spark):
    names = {"Meds__CEFEPIME IV 2 g__Antibiotics": {"antibiotic_iv"}, "Meds__CEFEPIME oral__Antibiotics": set(), "Meds__HEPARIN lock IV 5 ml__Antibiotics": set(), "Meds__PHENYLEPHRINE push dose__P": set(), "Meds__PHENYLEPHRINE drip__P": {"vasopressor"}, "Dx__Transplant candidate__D": {"noise"}, "Dx__Candida sepsis__D": {"fungal"}, None: set()}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    cols = H.classify(F.col("n"))
    for r in df.select("n", *[c.alias(k) for k, c in cols.items()]).collect():
        assert {k for k in cols if r[k]} == names[r.n], r.n


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EncounterEpicCsn,Event_DateTime,NumericValue,AdmissionDateValue\n1,2024-05-01 07:00:00.123,NULL,2024-05-02\nx,bad,3.5,Null\n")
    df = io.read_text_csv(spark, f"file://{tmp_path}/a.csv")
    assert rows(df, "NumericValue", "AdmissionDateValue") == sorted([(None, "2024-05-02"), ("3.5", None)], key=repr)
    cast = io.cast_known(df, {"EncounterEpicCsn": "long", "Event_DateTime": "datetime", "NumericValue": "double", "AdmissionDateValue": "date"})
    assert rows(cast, *cast.columns) == sorted([(1, dt.datetime(2024, 5, 1, 7, 0, 0, 123000), None, dt.datetime(2024, 5, 2)), (None, None, 3.5, None)], key=repr)
    inferred = io.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert dict(inferred.dtypes)["NumericValue"] == "double"
    b = spark.createDataFrame([("1", "u", "drop")], "EncounterEpicCsn string, Event_Datetime string, Event_ID string")
    both = io.harmonise([df, b], {"Event_Datetime": "Event_DateTime"}, ["Event_ID"])
    assert both.columns == df.columns and both.count() == 3
    assert io.mismatches({"a": df, "b": b})["b"] == (["AdmissionDateValue", "Event_DateTime", "NumericValue"], ["Event_Datetime", "Event_ID"])
    io.write_csv(df, f"file://{tmp_path}/out")
    io.write_table(df, f"file://{tmp_path}/tables", "one.parquet")
    assert set(io.load_folder(spark, f"file://{tmp_path}/tables")) == {"one"} and io.read_text_csv(spark, f"file://{tmp_path}/out").count() == 2
    assert io.missing_paths(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/none"]) == [f"file://{tmp_path}/none"]


def test_ingest(spark, tmp_path):
    lines = ["k,t,v,s", "1,2024-05-01 03:00:00.25,1.5,a", "2,05/02/2024 13:01,Null,NULL", "null,2024-05-01 00:00:00,2,b", "x7,2024-02-30 00:00:00,abc,c", "3,2024-05-01 00:00:00", '4,2024-03-10 02:30:00,3,"d,e"', "5,2024-05-01 00:00:00,4,f,g", " 6 ,null,5,", "7,1969-12-31 23:59:59.5,1e3,h"]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    kinds = {"k": "long", "t": ["yyyy-MM-dd HH:mm:ss[.SSSSSS][.SS][.S]", "MM/dd/yyyy HH:mm"], "v": "double", "s": "string"}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # skips 02:30 on that day
    try:
        good, rejected = io.ingest_csv(spark, f"file://{tmp_path}/x.csv", kinds, ["k"])
        assert rows(good, *kinds) == sorted([(1, at(3) + dt.timedelta(microseconds=250_000), 1.5, "a"), (2, dt.datetime(2024, 5, 2, 13, 1), None, None), (4, dt.datetime(2024, 3, 10, 2, 30), 3.0, "d,e"), (6, None, 5.0, None), (7, dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), 1000.0, "h")], key=repr)
        assert good.schema["t"].dataType.simpleString() == "timestamp_ntz"
        got = {tuple(r._reasons): r for r in rejected.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert set(got) == {("k: missing",), ("k: x7", "t: 2024-02-30 00:00:00", "v: abc"), ("fields",)} and rejected.count() == 4
    assert got["fields",]._line in (lines[5], lines[7]) and got["fields",]._file == "x.csv"


def test_combined_events(spark):
    e = spark.createDataFrame([(1, at(0), "x"), (1, at(0), "x"), (None, at(1), "y"), (2, None, "z")], "k int, t timestamp_ntz, v string")
    enc = spark.createDataFrame([(1, 40), (3, 50)], "k int, age int")
    assert rows(io.combine_events([e, e.limit(1)], enc, "k", "t"), "k", "t", "v", "age") == [(1, at(0), "x", 40)]
    wide = spark.createDataFrame([(1, at(0), 1, 2.0), (1, at(2), 5, None), (2, at(1), 3, 4.0)], "k int, t timestamp_ntz, a int, score double")
    enc, scores = io.split_extract(wide, "k", "t", ["a"], ["score"])
    assert rows(enc, "k", "a") == [(1, 5), (2, 3)] and rows(scores, "k", "t", "score") == sorted([(1, at(0), 2.0), (1, at(2), None), (2, at(1), 4.0)], key=repr)


def test_scenarios(spark, tmp_path):
    from tidemark.plans import cohort_queries as Q

    d, root = "/root/testdata/sf0.001", f"file://{tmp_path}/runs"
    ev = Q._clinical(spark, d)
    enc = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k", *[f"{x} AS {n}" for n, x in Q._BASE.items()])
    strict = C.Scenario(name="strict", columns=Q._CC, organ_hours=1, shock_hours=1)
    usual = C.Scenario(name="usual", columns=Q._CC)
    out = C.run_and_compare(spark, ev, enc, usual, strict, root)
    want = C.compare_scenarios(spark, {k: v for k, v in C.run(spark, ev, enc, usual).items()}, "strict", root, "k")
    assert out["overlap"].collect() == want["overlap"].collect() and out["matrix_sepsis_score_at_max"].count() == 3
    known = {r.run: r for r in manifest(spark, root).collect()}
    assert set(known) == {"usual", "strict"} and known["strict"].path == root and '"organ_hours": 1' in known["strict"].settings
    with pytest.raises(FileNotFoundError, match="strict, usual"):
        C.compare_scenarios(spark, "usual", "none", root, "k")
    stages = C.run(spark, ev, enc, usual)
    assert set(stages) == {"events", "bounded", "infect_long", "agg", "sirs", "organdysfunction", "septicshock", "o2vent", "sepsis1", "sepsis2", "sepsis3"} and all(t.columns for t in stages.values())


def test_a_run_after_another(spark, tmp_path):
    """The second of two compared runs takes what the label hours don't change from the first, if nothing else differs."""
    from tidemark.plans import cohort_queries as Q

    d, root = "/root/testdata/sf0.001", f"file://{tmp_path}/runs"
    raw, seen = cut(Q._clinical(spark, d)), spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    enc = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k", *[f"{x} AS {n}" for n, x in Q._BASE.items()])
    usual, strict = C.Scenario(name="usual", columns=Q._CC), C.Scenario(name="strict", columns=Q._CC, organ_hours=1, shock_hours=1)
    C.run_and_compare(spark, raw.mapInArrow(read, raw.schema), enc, usual, strict, root)
    assert seen.value == raw.count()  # the events are read once for both
    lazy = C.run(spark, raw, enc, strict)
    assert all(sorted(map(repr, spark.read.parquet(f"{root}/{t}/scenario=strict").collect())) == sorted(map(repr, lazy[t].collect())) for t in ("agg", "o2vent", "sepsis1", "sepsis2", "sepsis3"))
    other = C.Scenario(name="other", columns=Q._CC, bounds={"Pulse": (0, 100)})
    C.run_scenario(spark, raw.mapInArrow(read, raw.schema), enc, other, root, after=usual)
    assert seen.value == 2 * raw.count()


def test_a_broken_run_goes_on(spark, tmp_path):
    from tidemark.plans import cohort_queries as Q

    d, root = "/root/testdata/sf0.001", f"file://{tmp_path}/runs"
    raw, seen = cut(Q._clinical(spark, d)), spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    ev = raw.mapInArrow(read, raw.schema)
    enc = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k", *[f"{x} AS {n}" for n, x in Q._BASE.items()])
    s = C.Scenario(name="s", columns=Q._CC, bounds={"Pulse": (0, 300)})
    assert C.run_scenario(spark, ev, enc, s, root) == list(C.STAGES) and seen.value == raw.count()  # the events are read once
    labels = lambda: {t: sorted(map(repr, spark.read.parquet(f"{root}/{t}/scenario=s").collect())) for t in C.STAGES}
    want = labels()
    lazy = C.run(spark, raw, enc, s)
    assert all(sorted(map(repr, lazy[t].collect())) == want[t] for t in ("sepsis1", "sepsis2", "sepsis3"))
    # a driver that is lost while a stage is written leaves a folder without _SUCCESS
    for t in ("septicshock", "sepsis3"):
        (tmp_path / "runs" / t / "scenario=s" / "_SUCCESS").unlink()
    assert C.run_scenario(spark, ev, enc, s, root, resume=True) == ["septicshock", "sepsis3"]
    assert labels() == want and seen.value == raw.count()
    other = C.Scenario(name="s", columns=Q._CC, organ_hours=1)
    assert C.run_scenario(spark, ev, enc, other, root, resume=True) == list(C.STAGES)  # other thresholds: nothing is kept


def test_quantiles_of_large_groups(spark):
    """Selection by counting gives the values of the sorted groups: ties, extremes, infinities, nan, null groups."""
    r = np.random.default_rng(4)
    groups = {
        "normal": r.normal(0, 1, 3_000), "ties": r.integers(0, 4, 2_500).astype(float), "one": np.full(2_100, 7.5), "wide": 10.0 ** r.integers(-300, 300, 2_400) * r.choice([-1, 1], 2_400),
        "inf": np.r_[r.normal(0, 1, 2_100), [np.inf] * 200, [-np.inf] * 300], "nan": np.r_[r.normal(0, 1, 1_500), [np.nan] * 900], "ends": np.r_[[1.7e308, -1.7e308] * 1_050, [0.0]], "small": r.normal(0, 1, 40), None: r.random(2_050),
    }
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("small", None)], "g string, v double").repartition(5)
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.987, "e": 1.0}
    got = {x.g: x for x in K.quantiles(df, ["g"], "v", qs, most=2_000).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v = np.sort(v)
        for c, q in qs.items():
            at = (len(v) - 1) * q
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            want = lo if lo == hi or np.isnan(lo) else lo + (hi - lo) * (at - np.floor(at))
            assert got[g][c] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, c)
    one = K.quantiles(df.where("g = 'normal'"), [], "v", {"m": 0.5}, most=100).collect()
    assert one[0].m == pytest.approx(np.median(groups["normal"]), rel=1e-12)
    assert rows(K.quantiles(df.where("g = 'none'"), [], "v", {"m": 0.5}), "m") == [(None,)]


@pytest.mark.parametrize("name", ["asof", "fill", "spells", "thin", "episodes", "trajectory", "pareto", "summary"])
def test_empty_tables(spark, name):
    e = spark.createDataFrame([], "k int, t timestamp_ntz, v double, s string, u timestamp_ntz")
    out = {
        "asof": lambda: T.asof_join(e, e, ["k"], "t", "t", ["v"]), "fill": lambda: T.fill_forward(e, ["k"], "t", "v", "f"), "spells": lambda: T.spells(e, ["k"], "t", "s"), "thin": lambda: T.thin(e, ["k"], "t", 4),
        "episodes": lambda: T.episodes(e, ["k"], "t", F.col("s") == "a", F.col("s") == "b"), "trajectory": lambda: T.trajectory(e, ["k"], "t", "u", "v", [0, 1]), "pareto": lambda: R.pareto(e, "s", 0.5), "summary": lambda: R.summary(e, ["s"], "v"),
    }[name]()
    assert out.count() == 0
