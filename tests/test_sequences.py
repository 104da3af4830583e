"""Sequence operators against numpy/pandas restatements, whole and split into small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetra.operators import kinematics as K, smooth as S
from kinetra.operators.quantiles import quantiles
from kinetra.operators.recurrence import affine_scan, step
from kinetra.operators.sequence import Sequence, number_rows

KEYS = ("swing_id",)


def layouts(n):
    return [Sequence(KEYS, longest=n), Sequence(KEYS, block=16), Sequence(KEYS, block=9)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in enumerate([1, 2, 7, 40, 65]):
        x = np.cumsum(rng.normal(0, 1, n)) + (rng.random(n) < 0.08) * 25
        x[rng.random(n) < 0.2] = np.nan
        if s == 2:
            x[:] = np.nan
        rows += [(s, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "swing_id int, frame int, x double").cache()
    return df, pd.DataFrame(rows, columns=["swing_id", "frame", "x"]).astype({"x": float})


def same(spark_df, want, col="x"):
    got = spark_df.toPandas().sort_values(["swing_id", "frame"])[col].to_numpy(dtype=float)
    np.testing.assert_allclose(got, np.asarray(want, dtype=float), rtol=1e-9, atol=1e-9, equal_nan=True)


def per(pdf, fn):
    return np.concatenate([np.asarray(fn(g["x"].reset_index(drop=True)), dtype=float) for _, g in pdf.groupby("swing_id")])


@pytest.mark.parametrize("i", [0, 1, 2])
def test_interpolation(data, i):
    df, pdf = data
    seq = layouts(65)[i]
    same(S.interpolate(df, ["x"], seq), per(pdf, lambda s: s.interpolate(limit_direction="both")))
    same(S.interpolate(df, ["x"], seq, limit=1, fill="zero"), per(pdf, lambda s: s.interpolate(limit_direction="both", limit=1).fillna(0)))
    same(S.interpolate(df, ["x"], seq, limit=1, fill="ffill"), per(pdf, lambda s: s.interpolate(limit_direction="both", limit=1).ffill()))


@pytest.mark.parametrize("i", [0, 1, 2])
def test_rolling(data, i):
    df, pdf = data
    seq = layouts(65)[i]
    same(S.moving(df, ["x"], 5, seq=seq), per(pdf, lambda s: s.rolling(5, min_periods=1).mean()))
    same(S.moving(df, ["x"], 4, True, "median", seq), per(pdf, lambda s: s.rolling(4, center=True, min_periods=1).median()))

    def hampel(s):
        med = s.rolling(5, center=True, min_periods=1).median()
        d = (s - med).abs()
        t = 1.4826 * d.rolling(5, center=True, min_periods=1).median() * 3
        return s.where(~(d > t), med)
    # Windows that hold only missing values give no threshold: such rows stay.
    same(S.hampel(df, ["x"], 5, seq=seq), per(pdf, hampel))


@pytest.mark.parametrize("i", [0, 1, 2])
def test_ema(data, i):
    df, pdf = data
    seq = layouts(65)[i]
    same(S.ema(df, ["x"], 0.3, seq=seq), per(pdf, lambda s: s.ewm(alpha=0.3, adjust=False).mean()))

    def hold(s):
        out, prev = [], None
        for v in s:
            if not np.isnan(v):
                prev = v if prev is None else 0.3 * v + 0.7 * prev
            out.append(np.nan if prev is None else prev)
        return pd.Series(out).bfill()
    same(S.ema(df, ["x"], 0.3, "hold", seq), per(pdf, hold))


@pytest.mark.parametrize("i", [0, 1, 2])
def test_gaussian(data, i):
    df, pdf = data
    k = np.asarray(S.gaussian_kernel(5, None, True))

    def ref(s):
        y = np.convolve(s.ffill().bfill(), k, mode="full")[2:2 + len(s)]
        return np.where(s.isna(), np.nan, y)
    same(S.gaussian(df, ["x"], 5, seq=layouts(65)[i]), per(pdf, ref))


def one_euro_raw(s, dt=1 / 30):
    a = lambda c: 1 / (1 + 1 / (2 * np.pi * c) / dt)
    t = s.ffill().bfill().to_numpy()
    out, dh = [t[0]], 0.0
    for i in range(1, len(t)):
        dh = a(1.0) * (t[i] - t[i - 1]) / dt + (1 - a(1.0)) * dh
        g = a(1.0 + 0.007 * abs(dh))
        out.append(g * t[i] + (1 - g) * out[-1])
    return np.where(s.isna(), np.nan, out)


@pytest.mark.parametrize("i", [0, 1, 2])
def test_one_euro(data, i):
    df, pdf = data
    seq = layouts(65)[i]
    same(S.one_euro(df, ["x"], 30, seq=seq), per(pdf, one_euro_raw))

    def filtered(s):
        out, st = [], None
        for v in s:
            if not np.isnan(v):
                st = S.euro_step(v, st, 1 / 30, 1.0, 0.007, 1.0)
            out.append(np.nan if st is None else st[0])
        return pd.Series(out).ffill().bfill()
    same(S.one_euro(df, ["x"], 30, variant="filtered", seq=seq), per(pdf, filtered))


@pytest.mark.parametrize("i", [0, 1, 2])
def test_jumps(data, i):
    df, pdf = data

    def ref(s):
        x = s.interpolate(limit_direction="both").to_numpy()
        d = np.diff(x, prepend=x[0])
        m = np.median(np.abs(d))
        t = m + 5 * 1.4826 * np.median(np.abs(np.abs(d) - m))
        out = x.copy()
        for j in range(1, len(x)):
            if abs(d[j]) > t:
                out[j] = out[j - 1] + np.sign(d[j]) * t
        return out
    seq = layouts(65)[i]
    same(S.suppress_jumps(S.interpolate(df, ["x"], seq), ["x"], seq=seq), per(pdf, ref))


@pytest.mark.parametrize("i", [0, 1, 2])
def test_speed_golden(spark, i):
    """A gap carries the last speed; the first row is zero."""
    rows = [(0, f, v, 0.0) for f, v in enumerate([0.0, 3.0, None, 9.0])]
    df = spark.createDataFrame(rows, "swing_id int, frame int, x double, y double")
    seq = layouts(4)[i]
    out = seq.done(K.speed(seq.lay_out(df, 1), seq, {"v": ["x", "y"]}))
    assert [r.v for r in out.orderBy("frame").collect()] == [0.0, 3.0, 3.0, 3.0]


def test_box_filter_golden(spark):
    df = spark.createDataFrame([(0, i, float(i + 1)) for i in range(8)], "swing_id int, frame int, x double")
    for seq in (Sequence(KEYS, longest=8), Sequence(KEYS, block=4)):
        out = seq.done(seq.lay_out(df, 3, 2).withColumn("s", K.box_smooth("x", 6, seq) * 6))
        assert [round(r.s) for r in out.orderBy("frame").collect()] == [6, 10, 15, 21, 27, 33, 30, 26]


@pytest.mark.parametrize("i", [0, 1, 2])
def test_directions_and_unwrap(spark, i):
    rng = np.random.default_rng(9)
    rows, want = [], []
    for s in range(3):
        a = np.cumsum(rng.normal(0, 1.3, 50))
        v = np.stack([np.cos(a), np.sin(a), np.zeros(50)], 1) * rng.choice([-1, 1], 50)[:, None]
        v[rng.random(50) < 0.1] = np.nan
        out = v.copy()
        for j in range(1, 50):
            if not (np.isnan(out[j - 1]).any() or np.isnan(out[j]).any()) and out[j] @ out[j - 1] < 0:
                out[j] = -out[j]
        th = np.arctan2(out[:, 1], out[:, 0])
        ok = ~np.isnan(th)
        un = np.full(50, np.nan)
        un[ok] = np.degrees(np.unwrap(th[ok]))
        want += un.tolist()
        rows += [(s, j, *[None if np.isnan(c) else float(c) for c in p]) for j, p in enumerate(v)]
    df = spark.createDataFrame(rows, "swing_id int, frame int, a double, b double, c double")
    seq = layouts(50)[i]
    laid = K.continuous_directions(seq.lay_out(df, 1), seq, {"n": ("a", "b", "c")})
    laid = K.unwrapped(laid.withColumn("t", F.atan2("b", "a")), seq, ["t"])
    same(seq.done(laid), want, "t")


@pytest.mark.parametrize("i", [0, 1, 2])
def test_run_cleanup(spark, i):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for s in range(4):
        a = rng.random(60) < 0.55
        rows += [(s, j, int(v)) for j, v in enumerate(a)]
        want += clean(a, 3, 2).astype(int).tolist()
    df = spark.createDataFrame(rows, "swing_id int, frame int, x int")
    seq = layouts(60)[i]
    reach = 2 + 2
    same(seq.done(K.clean_runs(seq.lay_out(df, 2 * reach, 2 * reach), seq, "x", 3, 2)), want)


def clean(a, min_true, max_false):
    out = a.copy()
    for value, limit in ((True, min_true - 1), (False, max_false)):
        j = 0
        while j < len(out):
            k = j
            while k < len(out) and out[k] == out[j]:
                k += 1
            if out[j] == value and k - j <= limit:
                out[j:k] = not value
                j = 0 if False else k
            else:
                j = k
    return out


def test_affine_scan_levels(spark):
    """Two levels of blocks give the same running sums as one array."""
    df = spark.range(200).select(F.lit(1).alias("swing_id"), F.col("id").cast("int").alias("frame"), (F.col("id") % 7).cast("double").alias("x"))
    out = affine_scan(df, Sequence(KEYS), {"t": step(F.lit(1.0), F.col("x"), F.col("x"))}, block=5)
    want = np.cumsum([i % 7 for i in range(200)])
    assert [r.t for r in out.orderBy("frame").collect()] == want.tolist()


def test_quantiles_hot_path(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(v)) for v in rng.normal(0, 1, 900)] + [(0, 0.5)] * 500 + [(1, float(v)) for v in rng.normal(0, 1, 11)] + [(2, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    spec = {"a": (F.col("v"), 0.1), "m": (F.col("v"), 0.5), "z": (F.col("v"), 0.93)}
    got = {r.k: r for r in quantiles(df, ["k"], spec, size=64).collect()}
    for k in (0, 1):
        x = [v for kk, v in rows if kk == k]
        np.testing.assert_allclose([got[k].a, got[k].m, got[k].z], np.quantile(x, [0.1, 0.5, 0.93]))
    assert got[2].m is None


def test_quantiles_of_split_groups(spark):
    """A hot group in parts, ties, values that are no numbers, and the ends: as over the whole group, the input read twice."""
    rng = np.random.default_rng(3)
    inf, nan = float("inf"), float("nan")
    groups = {"hot": np.r_[rng.normal(0, 1, 20000), np.full(6000, 0.25)], "flat": np.full(3000, 7.0), "odd": np.r_[rng.integers(0, 5, 900), [-inf, inf]],
              "two": np.array([1.0, 4.0]), "one": np.array([-3.5])}
    rows = [(k, i % 9, float(v)) for k, x in groups.items() for i, v in enumerate(x)] + [("none", 0, None), ("hot", 4, None), ("hot", 11, None), ("nan", 1, 2.0), ("nan", 1, nan)]
    df = spark.createDataFrame(rows, "k string, part int, v double").repartition(7)
    shares = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    spec = {f"q{i}": (F.col("v"), p) for i, p in enumerate(shares)}
    for size in (64, 512):
        found = quantiles(df, ["k"], spec, F.col("part"), size)
        got = {r.k: list(r)[1:] for r in found.collect()}
        for k, x in groups.items():
            with np.errstate(invalid="ignore"):
                np.testing.assert_allclose(got[k], np.quantile(x, shares), rtol=1e-12)
        assert got["none"] == [None] * 6 and got["nan"][0] == 2.0 and np.isnan(got["nan"][5])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert quantiles(df.limit(0), ["k"], spec).collect() == []


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"), F.xxhash64("id").alias("h"))
    out = number_rows(df, ["k"], [F.col("h")], F.shiftright("h", 60), "row", "n").toPandas()
    for _, g in out.groupby("k"):
        assert g.sort_values("h")["row"].tolist() == list(range(len(g)))
        assert (g["n"] == len(g)).all()


def test_static_trim_self_test(spark):
    """Still, moving, still. Ten still frames at an end are a fillable gap, thirty are trimmed; a still
    clip and a tiny one keep everything."""
    rng = np.random.default_rng(0)
    rows = []
    for s, kp in enumerate([np.concatenate([np.zeros((10, 17, 2)), rng.normal(0, 5, (20, 17, 2)), np.zeros((10, 17, 2))]),
                            np.zeros((30, 17, 2)), rng.normal(0, 5, (2, 17, 2)),
                            np.concatenate([np.zeros((30, 17, 2)), rng.normal(0, 5, (20, 17, 2)), np.zeros((30, 17, 2))])]):
        rows += [(s, t, 0, j, float(x), float(y)) for t, f in enumerate(kp) for j, (x, y) in enumerate(f)]
    df = spark.createDataFrame(rows, "swing_id int, frame int, person_idx int, joint_idx int, x double, y double")
    got = []
    for seq in (Sequence(KEYS, longest=80), Sequence(KEYS, block=30)):
        got.append({r.swing_id: (r.start, r.end) for r in K.static_trim(df, seq).collect()})
    assert got[0] == got[1]
    assert got[0][1] == (0, 29) and got[0][2] == (0, 1)
    assert got[0][0] == (0, 39)
    # Motion runs from frame 30 to 50; the filter reaches 2 back and 3 ahead, padding adds 3.
    assert got[0][3] == (25, 56)
