"""NaN, zero divisors, warm-up, ties and periods, by hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import reductions as red
from tidemill.functions import scalar as sc
from tidemill.operators import indicators as ta
from tidemill.operators import series as ops
from tidemill.operators.series import Series

NAN = math.nan


def _run(spark, values, op, key=None):
    rows = [(0, i, *map(float, v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    width = len(rows[0]) - 2
    names = ["x"] if width == 1 else ["open", "high", "low", "close", "volume"][:width] if width != 2 else ["high", "low"]
    df = spark.createDataFrame(rows, "k int, i int, " + ", ".join(f"{n} double" for n in names))
    out = Series(df, ["k"], "i").compute(out=op)
    column = key or "out"
    return [r[column] for r in out.orderBy("i").collect()]


def _same(a, b, tolerance=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x != x and y != y) or x == pytest.approx(y, rel=tolerance, abs=1e-12), (a, b)


def test_ieee_division(spark):
    row = spark.range(1).select(
        sc.div(F.lit(1.0), F.lit(0.0)).alias("a"), sc.div(F.lit(1.0), F.lit(-0.0)).alias("b"), sc.div(F.lit(0.0), F.lit(0.0)).alias("c"), sc.div(F.lit(-3.0), F.lit(0.0)).alias("d"),
        sc.log(F.lit(0.0)).alias("e"), sc.log(F.lit(-1.0)).alias("f"), sc.log1p(F.lit(-1.0)).alias("g"), sc.round_(F.lit(-2.5)).alias("h"), sc.round_(F.lit(0.49999999999999994)).alias("i"),
        sc.floor(F.lit(1e300)).alias("j"), sc.sign(F.lit(NAN)).alias("k"), sc.safe_div(F.lit(2.0), F.lit(0.0)).alias("l"), sc.clamp(F.lit(NAN), 0.0, 1.0).alias("m"), sc.clamp(F.lit(5.0), 3.0, 1.0).alias("n"),
    ).first()
    assert row.a == math.inf and row.b == -math.inf and row.c != row.c and row.d == -math.inf
    assert row.e == -math.inf and row.f != row.f and row.g == -math.inf and row.h == -3 and row.i == 0 and row.j == 1e300
    assert row.k != row.k and row.l == 0 and row.m != row.m and row.n == 1


def test_empty_reductions(spark):
    empty = spark.createDataFrame([], "x double, y double, i long, m boolean")
    r = empty.agg(
        red.sum_("x").alias("sum"), red.mean("x").alias("mean"), red.min_("x").alias("min"), red.max_("x").alias("max"), red.variance("x").alias("var"), red.median("x").alias("med"),
        red.arg_min("x", "i").alias("arg"), red.all_true("m").alias("all"), red.any_true("m").alias("any"), red.has_nan("x").alias("nan"), red.first_valid("x", "i").alias("first"),
    ).first()
    assert (r["sum"], r["mean"], r["min"], r["max"], r["arg"], r["all"], r["any"], r["nan"], r["first"]) == (0, 0, math.inf, -math.inf, -1, True, False, False, -1)
    assert r["var"] != r["var"] and r["med"] != r["med"]


def test_rolling_recovers_after_nan(spark):
    x = [5.0, 2.0, 8.0, NAN, 3.0, 9.0, 1.0, 7.0]
    _same(_run(spark, x, lambda s: ta.highest(s, "x", 3)), [NAN, NAN, 8, NAN, NAN, NAN, 9, 9])
    _same(_run(spark, x, lambda s: ta.lowest(s, "x", 3)), [NAN, NAN, 2, NAN, NAN, NAN, 1, 1])


def test_known_extremes_and_eviction(spark):
    _same(_run(spark, [3.0, 1, 4, 1, 5, 9, 2, 6], lambda s: ta.highest(s, "x", 3)), [NAN, NAN, 4, 4, 5, 9, 9, 9])
    assert _run(spark, [1e16, *[1.0] * 7], lambda s: ops.rolling_sum(s, "x", 2))[2] == 2


def test_ema_seed_and_poison(spark):
    _same(_run(spark, [10.0, 20, 30, 40, 50], lambda s: ta.ema(s, "x", 3)), [NAN, NAN, 20, 30, 40])
    _same(_run(spark, [1.0, 2, 3, NAN, 5, 6], lambda s: ta.rma(s, "x", 2)), [NAN, 1.5, 2.25, NAN, NAN, NAN])


def test_period_longer_than_series_is_nan(spark):
    _same(_run(spark, [1.0, 2.0], lambda s: ta.sma(s, "x", 5)), [NAN, NAN])
    _same(_run(spark, [1.0, 2.0], lambda s: ta.rsi(s, "x", 5)), [NAN, NAN])


@pytest.mark.parametrize("op", [lambda s: ta.sma(s, "x", 0), lambda s: ta.ema(s, "x", 0), lambda s: ta.alma(s, "x", 5, 2.0, 6.0), lambda s: ta.linear_regression(s, "x", 1), lambda s: ops.rolling_quantile(s, "x", 3, 1.5)])
def test_bad_arguments_raise(spark, op):
    with pytest.raises(ValueError):
        _run(spark, [1.0, 2.0], op)


def test_neutral_values(spark):
    flat = [(5.0, 5.0, 5.0, 5.0, 0.0)] * 6
    _same(_run(spark, flat, lambda s: ta.stochastic(s, "high", "low", "close", 2, 1, 1), "out_k"), [NAN, 50, 50, 50, 50, 50])
    _same(_run(spark, flat, lambda s: ta.williams_percent_r(s, "high", "low", "close", 2)), [NAN, 0, 0, 0, 0, 0])
    _same(_run(spark, flat, lambda s: ta.rsi(s, "close", 2)), [NAN, NAN, 50, 50, 50, 50])
    _same(_run(spark, flat, lambda s: ta.cci(s, "high", "low", "close", 2)), [NAN, 0, 0, 0, 0, 0])
    _same(_run(spark, flat, lambda s: ta.vwap(s, "high", "low", "close", "volume")), [0.0] * 6)
    _same(_run(spark, flat, lambda s: ta.choppiness(s, "high", "low", "close", 2)), [NAN, 0, 0, 0, 0, 0])
    _same(_run(spark, flat, lambda s: ta.r2(s, "close", 3)), [NAN, NAN, 0, 0, 0, 0])
    _same(_run(spark, flat, lambda s: ops.rolling_correlation(s, "close", "high", 3)), [NAN] * 6)
    assert _run(spark, [1.0, 2, 3], lambda s: ta.rsi(s, "x", 2))[2] == 100


def test_true_range_ignores_nan_close(spark):
    bars = [(0.0, 5.0, 1.0, NAN, 0.0), (0.0, 6.0, 3.0, 4.0, 0.0), (0.0, 9.0, 8.0, 8.5, 0.0)]
    _same(_run(spark, bars, lambda s: ta.true_range(s, "high", "low", "close")), [4, 3, 5])


def test_argsort_rank_and_sort_place_nan(spark):
    x = [2.0, NAN, 1.0, 2.0]
    assert _run(spark, x, lambda s: ops.argsort(s, "x")) == [1, 3, 0, 2]
    assert _run(spark, x, lambda s: ops.sort_copy(s, "x")) == [2, 0, 1, 3]
    _same(_run(spark, x, lambda s: ops.rank(s, "x")), [2.5, NAN, 1, 2.5])


def test_fractal_is_reported_late(spark):
    bars = [(h, h - 1) for h in (1.0, 2, 5, 2, 1, 0, 1)]
    assert _run(spark, bars, lambda s: ta.williams_fractal(s, "high", "low", 2), "out_up") == [False, False, False, False, True, False, False]


def test_nulls_count_as_nan(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, 3.0, 4.0])], "k int, i int, x double")
    out = [r.e for r in Series(df, ["k"], "i").compute(e=lambda s: ops.rolling_ema(s, "x", 2)).orderBy("i").collect()]
    assert all(v != v for v in out)


def test_kernel_restarts_by_key_and_keeps_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(0)
        rows = [(k, i, float(v)) for k in range(5) for i, v in enumerate(rng.normal(size=23))]
        df = spark.createDataFrame(rows, "k int, i int, x double").repartition(3)
        got = {(r.k, r.i): r.e for r in Series(df, ["k"], "i").compute(e=lambda s: ta.ema(s, "x", 4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(5):
        values, y = [v for key, _, v in rows if key == k], None
        for i, v in enumerate(values):
            y = None if i < 3 else sum(values[:4]) / 4 if i == 3 else 0.4 * v + 0.6 * y
            assert (y is None and got[k, i] != got[k, i]) or got[k, i] == pytest.approx(y, rel=1e-12)


def test_max_drawdown(spark):
    def of(values):
        df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "k int, i long, x double")
        r = red.max_drawdown(df, ["k"], "x", "i").first()
        return r.max_drawdown, r.peak, r.trough, r.recovery

    assert of([-1, 4, 2, 4, 1, 5, 3]) == (0.75, 1, 4, 5)
    assert of([1, 2, 3]) == (0.0, -1, -1, -1)
    dd = of([-1.0, -2.0])
    assert dd[0] != dd[0] and dd[1:] == (-1, -1, -1)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_max_drawdown_in_ranges_equals_one_pass(spark, parts):
    rng = np.random.default_rng(5)
    groups = {"a": np.round(rng.normal(size=90).cumsum() + 5, 1), "b": np.round(rng.random(35) * 3), None: np.array([2.0, 1.0, 3.0, 1.5, 3.0]), "up": np.arange(1.0, 9), "one": np.array([4.0]), "below": np.array([-1.0, -3.0])}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in groups.items() for i, v in enumerate(x)], "k string, i long, x double").repartition(5)
    found = {r.k: tuple(r)[1:] for r in red.max_drawdown(df, ["k"], "x", "i", parts).collect()}
    assert found.keys() == groups.keys()
    for k, x in groups.items():
        best, top, want = 0.0, NAN, (0.0, -1, -1, -1)
        for i, v in enumerate(x.tolist()):
            top = v if v > 0 and not top >= v else top
            if top > 0 and (top - v) / top > best:
                best = (top - v) / top
                later = [j for j in range(i + 1, len(x)) if x[j] >= top]
                want = (best, x.tolist().index(top), i, later[0] if later else -1)
        if top != top:
            assert found[k][0] != found[k][0] and found[k][1:] == (-1, -1, -1)
        else:
            assert found[k] == want, k
    whole = red.max_drawdown(df.where("k = 'a'"), [], "x", "i", parts).first()
    assert tuple(whole) == found["a"]
    assert red.max_drawdown(df.limit(0), ["k"], "x", "i", parts).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 23])
def test_long_windows_by_kernel_equal_frames(spark, n, monkeypatch):
    rng = np.random.default_rng(7)
    x = [float(v) if i != 31 else NAN for i, v in enumerate(np.round(rng.normal(size=70), 1))]
    each = [lambda s: ops.rolling_quantile(s, "x", n, 0.3), lambda s: ops.rolling_median(s, "x", n), lambda s: ops.rolling_percent_rank(s, "x", n), lambda s: ops.rolling_max(s, "x", n), lambda s: ops.rolling_min(s, "x", n)]
    frames = [_run(spark, x, op) for op in each]
    monkeypatch.setattr(ops, "LONG_ORDER", 0)
    frames[3:] = [_run(spark, x, lambda s: s.max("x", n)), _run(spark, x, lambda s: s.min("x", n))]
    for op, want in zip(each, frames, strict=True):
        _same(_run(spark, x, op), want)
