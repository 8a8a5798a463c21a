"""Kernels by runs of rows against plain definitions, however rows are cut."""

import numpy as np
import pandas as pd
import pytest

from tidemill.operators import kernels as k
from tidemill.operators import series as ops
from tidemill.operators.series import Series

RNG = np.random.default_rng(3)
X = RNG.normal(size=700) * 10
Y = RNG.normal(size=700) + X / 7
GAPS = X.copy()
GAPS[[0, 90, 91, 400]] = np.nan
INF = X.copy()
INF[[150, 151]] = np.inf, -np.inf


def _cut(kernel, inputs, sizes):
    out, at, i = [], 0, 0
    while at < len(inputs[0]):
        out.append(kernel.run(*[x[at : at + sizes[i % len(sizes)]] for x in inputs]))
        at += sizes[i % len(sizes)]
        i += 1
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _same(got, want, rel=1e-9):
    np.testing.assert_allclose(got, want, rtol=rel, atol=1e-9, equal_nan=True)


def _windows(n, f, *xs):
    return [np.nan if i < n - 1 or any(np.isnan(x[i - n + 1 : i + 1]).any() for x in xs) else f(*[x[i - n + 1 : i + 1] for x in xs]) for i in range(len(xs[0]))]


CUTS = [(700,), (1,), (7, 64, 3, 200), (65, 300)]


@pytest.mark.parametrize("cuts", CUTS)
@pytest.mark.parametrize("n", [1, 2, 7, 20, 333])
def test_windows(cuts, n):
    for x in (X, GAPS):
        for moving, plain in (
            (k.moving_sum, np.sum), (k.moving_max, np.max), (k.moving_min, np.min), (k.moving_variance, np.var), (lambda v, n: k.moving_quantile(v, n, 0.3), lambda w: np.quantile(w, 0.3)),
            (k.moving_percent_rank, lambda w: 100 * (w < w[-1]).sum() / n), (lambda v, n: k.moving_weighted(v, np.arange(n) + 1.0), lambda w: w @ (np.arange(n) + 1.0)),
        ):
            _same(_cut(k.Window(n, moving), [x], cuts)[0], _windows(n, plain, x))
        for ranked, plain in (
            (lambda v, n: k.moving_quantile(v, n, 0.3, True), lambda w: np.quantile(w, 0.3)), (lambda v, n: k.moving_quantile(v, n, 1.0, True), np.max), (lambda v, n: k.moving_percent_rank(v, n, True), lambda w: 100 * (w < w[-1]).sum() / n),
            (k.moving_abs_deviation, lambda w: np.abs(w - w.mean()).mean()), (lambda v, n: k.moving_abs_deviation(v, n, True), lambda w: np.abs(w - w.mean()).mean()),
        ):
            for values in (x, np.round(x)):  # and with many ties
                _same(_cut(k.Window(n, ranked), [values], cuts)[0], _windows(n, plain, values))
        if n in (7, 20):
            ties = np.round(Y)
            _same(_cut(k.Window(n, k.moving_rank_correlation, 2), [x, ties], cuts)[0], _windows(n, lambda a, b: pd.Series(a).rank().corr(pd.Series(b).rank()), x, ties))
        _same(_cut(k.Window(n, k.moving_covariance, 2), [x, Y], cuts)[0], _windows(n, lambda a, b: np.cov(a, b, ddof=0)[0, 1], x, Y))
        if n > 2:
            _same(_cut(k.Window(n, k.moving_correlation, 2), [x, Y], cuts)[0], _windows(n, lambda a, b: np.corrcoef(a, b)[0, 1], x, Y))
    inf = _cut(k.Window(n, k.moving_sum), [INF], cuts)[0]
    assert np.isfinite(inf[n - 1 : 150]).all() and np.isfinite(inf[151 + n :]).all()


def test_order_statistics_take_the_same_steps_for_any_period():
    x = np.random.default_rng(1).standard_normal(5000)
    ranked = k.Ranked(x, sums=True)
    assert len(ranked.levels) == 13
    first = np.arange(1000)
    for n in (1, 64, 4000):
        count, total = ranked.below(first, first + n, np.full(1000, 2500))
        inside = [np.sort(x[i : i + n]) for i in (0, 500, 999)]
        limit = ranked.values[2500]
        assert [count[0], count[500], count[999]] == [(w < limit).sum() for w in inside]
        _same([total[0], total[500], total[999]], [w[w < limit].sum() for w in inside])
        assert [ranked.kth(first, first + n, n // 2)[i] for i in (0, 500, 999)] == [w[n // 2] for w in inside]
    assert k.moving_abs_deviation(np.full(9, 0.1), 3, True).tolist() == [0.0] * 7


def test_nothing_is_left_of_values_that_have_gone():
    x = np.array([1e16, *[1.0] * 7, 1e300, 2.0, 2.0, 2.0])
    for cuts in ((12,), (1,), (5,)):
        sums = _cut(k.Window(2, k.moving_sum), [x], cuts)[0]
        assert sums[2:8].tolist() == [2.0] * 6 and sums[10:].tolist() == [4.0, 4.0]
        assert _cut(k.Window(3, k.moving_variance), [x], cuts)[0][11] == 0
    shifted = 1e9 + X
    _same(_cut(k.Window(20, k.moving_variance), [shifted], (64,))[0], _windows(20, np.var, shifted), rel=1e-5)


def _smoothed(x, alpha, n, start):
    out, value, seed = [], np.nan, []
    for i, v in enumerate(x):
        if start is not None and i < start or start is None and not seed and np.isnan(v):
            out.append(np.nan)
        elif len(seed) < n:
            seed.append(v)
            value = np.mean(seed) if len(seed) == n else np.nan
            out.append(value)
        else:
            value = alpha * v + (1 - alpha) * value
            out.append(value)
    return out


@pytest.mark.parametrize("cuts", CUTS)
@pytest.mark.parametrize("alpha, n, start", [(0.1, 5, 0), (0.5, 1, 3), (2 / 201, 200, None), (1.0, 2, None)])
def test_smoother(cuts, alpha, n, start):
    for x in (X, GAPS, INF, np.concatenate([[np.nan] * 5, X[5:]])):
        _same(_cut(k.Smoother(alpha, n, start), [x], cuts)[0], _smoothed(x, alpha, n, start))
    one, two = _cut(k.Chain(alpha, n, 2), [X], cuts)
    _same(one, _smoothed(X, alpha, n, 0))
    _same(two, _smoothed(one, alpha, n, None))


@pytest.mark.parametrize("cuts", CUTS)
def test_strength_and_adaptive(cuts):
    n = 14
    price = np.round(100 + np.cumsum(X) / 50, 1)
    moves = np.diff(price, prepend=np.nan)[1:]
    up, down = (_smoothed(np.maximum(s * moves, 0), 1 / n, n, 0) for s in (1, -1))
    want = [np.nan, *[100 - 100 / (1 + u / d) if d else 50.0 for u, d in zip(up, down, strict=True)]]
    _same(_cut(k.Strength(n), [price], cuts)[0], want)
    assert _cut(k.Strength(2), [np.full(700, 3.0)], cuts)[0][5] == 50 and _cut(k.Strength(2), [np.arange(700.0)], cuts)[0][5] == 100
    gains = np.abs(np.sin(np.arange(700)))
    got = _cut(k.Adaptive(lambda row, x, g: (row == 9, g)), [X, gains], cuts)[0]
    want, value = [np.nan] * 9 + [X[9]], X[9]
    for g, v in zip(gains[10:], X[10:], strict=True):
        value += g * (v - value)
        want.append(value)
    _same(got, want)


def _streak():
    before, length = np.nan, np.nan

    def step(x):
        nonlocal before, length
        if x != x or before != before:
            length = np.nan
        elif x > before:
            length = length + 1 if length > 0 else 1.0
        elif x < before:
            length = length - 1 if length < 0 else -1.0
        else:
            length = 0.0
        before = x
        return (length,)

    return step


def _volume_force():
    before, width, trend, total = np.nan, np.nan, 0.0, 0.0

    def step(high, low, close, volume):
        nonlocal before, width, trend, total
        price, last, old, wide = high + low + close, before, width, high - low
        before, width = price, wide
        if price != price or last != last or volume != volume or wide != wide or old != old:
            return (np.nan,)
        way = -1.0 if price < last else 1.0
        total = wide if not trend else total + wide if way == trend else old + wide
        trend = way
        return (volume * abs(2 * (wide / total - 1)) * way * 100 if total else 0.0,)

    return step


@pytest.mark.parametrize("cuts", CUTS)
def test_streak_and_volume_force(cuts):
    steps = np.round(GAPS / 8)
    _same(_cut(k.Streak(), [steps], cuts)[0], k.Rows(_streak()).run(steps)[0])
    low = np.round(np.abs(X))
    high, close, volume = low + np.round(np.abs(Y) / 4), low, 1 + np.abs(X)
    volume[[50, 51]] = np.nan
    close = np.where(np.isnan(GAPS), np.nan, close)
    _same(_cut(k.VolumeForce(), [high, low, close, volume], cuts)[0], k.Rows(_volume_force()).run(high, low, close, volume)[0])


def test_series_without_keys_is_cut_into_pieces(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, x double").repartition(6)
    own = {r.i: r for r in Series(df, [], "i").compute(e=lambda s: ops.rolling_ema(s, "x", 9), r=lambda s: ops.rolling_rma(s, "x", 5)).collect()}
    one = {r.i: r for r in Series(df.selectExpr("1 as k", "*"), ["k"], "i").compute(e=lambda s: ops.rolling_ema(s, "x", 9), r=lambda s: ops.rolling_rma(s, "x", 5, pieces=7)).collect()}
    for name in ("e", "r"):
        _same([own[i][name] for i in range(3000)], [one[i][name] for i in range(3000)])


def test_keys_that_are_null_or_go_on_in_the_next_batch(spark):
    rows = [(key, i, float(i % 7)) for key in ("a", "b", None, "") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        got = {(r.k, r.i): r.s for r in Series(df, ["k"], "i").compute(s=lambda s: ops.rolling_sum(s, "x", 5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for key in ("a", "b", None, ""):
        _same([got[key, i] for i in range(300)], _windows(5, np.sum, np.arange(300.0) % 7))
