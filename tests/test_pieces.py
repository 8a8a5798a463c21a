"""Series in blocks equal series by key, row by row; order statistics by selection equal those of sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import indicators as ta
from tidemill.operators import series as ops
from tidemill.operators.pieces import expand
from tidemill.operators.selection import median_abs_deviation, quantiles
from tidemill.operators.series import Series

HIGH, LOW = "upper", "lower"


def _after_machine(s):
    """A machine of what looks back, looked back at."""
    low = yield s.min("x", 3)
    bars = yield from ta.parabolic_sar(s, low + 2, low, 0.02, 0.02, 0.2)
    held = yield bars["sar"]
    return s.back(held, 2)


GROUPS = {
    "running": {
        "sum": lambda s: ops.cum_sum(s, "x"), "product": lambda s: ops.cum_prod(s, 1 + F.col("z") / 100), "max": lambda s: ops.cum_max(s, "z"), "min": lambda s: ops.cum_min(s, "z"),
        "count": lambda s: ops.cum_count_true(s, "m"), "drawdown": lambda s: ops.drawdown(s, "x"), "value_when": lambda s: ops.value_when(s, "m", "z"), "index": lambda s: s.index(),
    },
    "since": {"bars": lambda s: ops.bars_since(s, "m"), "high": lambda s: ops.highest_since(s, "m", "x"), "low": lambda s: ops.lowest_since(s, "m", "z"), "late": lambda s: ops.highest_since(s, F.col("x") > s.back("x", 2), s.back("x", 1))},
    "windows": {
        "sum": lambda s: ops.rolling_sum(s, "z", 7), "median": lambda s: ops.rolling_median(s, "x", 9), "corr": lambda s: ops.rolling_correlation(s, "x", "z", 5), "before": lambda s: ops.shift(s, "x", 3),
        "ahead": lambda s: ops.shift(s, "x", -2), "bands": lambda s: ta.bollinger_bands(s, "x", 8, 2.0), "cloud": lambda s: ta.ichimoku(s, HIGH, LOW, "x", 3, 5, 7, 4),
    },
    "sorts": {"sort": lambda s: ops.sort_copy(s, "t"), "argsort": lambda s: ops.argsort(s, "z"), "rank": lambda s: ops.rank(s, "t"), "rank_z": lambda s: ops.rank(s, "z")},
    # Scans of what looks back, looks back at scans, scans of scans, and what can't be divided.
    "composed": {
        "macd": lambda s: ta.macd(s, "x", 3, 6, 4), "obv": lambda s: ta.obv(s, "x", "t"), "force": lambda s: ta.force_index(s, "x", "t", 4), "adx": lambda s: ta.directional_movement(s, HIGH, LOW, "x", 5),
        "chaikin": lambda s: ta.chaikin_oscillator(s, HIGH, LOW, F.col("x") + F.col("t") / 2, "t", 3, 6),
    },
    "machines": {
        "trend": lambda s: ta.supertrend(s, HIGH, LOW, "x", 5, 2.0), "sar": lambda s: ta.parabolic_sar(s, HIGH, LOW, 0.02, 0.02, 0.2), "zig": lambda s: ta.zig_zag(s, HIGH, LOW, 0.1), "fisher": lambda s: ta.fisher_transform(s, HIGH, LOW, 4),
        "mcginley": lambda s: ta.mcginley_dynamic(s, "x", 5), "klinger": lambda s: ta.klinger_oscillator(s, HIGH, LOW, "x", "t", 3, 6, 4), "before": _after_machine, "poisoned": lambda s: ta.mcginley_dynamic(s, "z", 5),
    },
    "sequential": {"trend": lambda s: ta.rsi(s, "x", 5), "reverse": lambda s: ops.reverse(s, "x"), "sum": lambda s: ops.cum_sum(s, "x")},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k, n in (("a", 150), ("b", 1), (None, 37)):
        for i in range(n):  # few early rows far from many later ones
            nan = rng.random() < 0.03 and i > 90
            out.append((k, i * i + (10**6 if i > n * 0.1 else 0), rng.gauss(50, 10), math.nan if nan else rng.gauss(0, 1), round(rng.random() * 4) / 2 if rng.random() < 0.6 else 1.5, rng.random() < 0.08))
    return spark.createDataFrame(out, "k string, i long, x double, z double, t double, m boolean").selectExpr("*", "x + 1 upper", "x - 1 lower").repartition(3).cache()


def _near(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and ((a != a and b != b) or abs(a - b) <= 1e-9 * max(1, abs(b))))


@pytest.mark.parametrize("group", GROUPS)
@pytest.mark.parametrize("pieces,keys", [(5, ["k"]), (40, [])])  # blocks longer and shorter than the periods
def test_blocks_equal_rows(spark, rows, group, pieces, keys):
    df = rows if keys else rows.where("k = 'a'")
    want = {(r.k, r.i): r for r in Series(df, ["k"], "i", 0).compute(**GROUPS[group]).collect()}
    got = Series(df, keys, "i", pieces).compute(**GROUPS[group]).collect()
    assert len(got) == len(want)
    for r in got:
        other = want[(r.k, r.i)]
        assert r.__fields__ == other.__fields__
        assert all(_near(a, b) for a, b in zip(r, other, strict=True)), (r, other)


STATES = {k: GROUPS["machines"][k] for k in ("sar", "zig", "fisher", "mcginley")}


@pytest.mark.parametrize("keys", [["k"], []])
def test_machines_in_blocks_equal_one_run_bit_by_bit(spark, rows, keys):
    df = rows if keys else rows.where("k = 'a'")
    # The highest row comes first and no low is ever low enough: each block waits for the one before.
    falling = F.lit(2e6) - F.col("i")
    far = {"far": lambda s: ta.zig_zag(s, falling, falling, 0.9)}
    one, cut = Series(df, ["k"], "i", 0), Series(df, keys, "i", 6)
    want = {(r.k, r.i): np.array(r[7:], float).tobytes() for r in one.compute(**STATES, **far).collect()}
    got = {(r.k, r.i): np.array(r[7:], float).tobytes() for r in cut.compute(**STATES, **far).collect()}
    assert got == want
    assert not one.reruns and all(len(again) <= 4 for again in cut.reruns)
    assert ([8, 6, 4, 2] if keys else [4, 3, 2, 1]) in cut.reruns  # keys a and null; b has one row
    settled = Series(df, keys, "i", 3)
    settled.compute(sar=STATES["sar"])
    assert len(settled.reruns) == 1 and len(settled.reruns[0]) <= 1


def test_blocks_are_even_and_halos_complete(spark):
    df = spark.range(1000).select(F.pow("id", F.lit(6)).cast("long").alias("i"))
    out = expand(df, [], "i", 4, 2, 8).groupBy("_block", "_side").count().collect()
    assert {(r._block, r._side): r["count"] for r in out} == {(b, s): n for b in range(8) for s, n in ((0, 125), (-1, 4), (1, 2)) if (b, s) not in ((0, -1), (7, 1))}


def test_empty_series_and_order_columns_that_cannot_be_cut(spark):
    empty = spark.createDataFrame([], "i long, x double")
    found = Series(empty, [], "i").compute(a=lambda s: ops.cum_sum(s, "x"), b=lambda s: ops.rolling_ema(s, "x", 3), c=lambda s: ops.rank(s, "x"), d=lambda s: ops.rolling_sum(s, "x", 3))
    assert found.columns == ["i", "x", "a", "b", "c", "d"] and found.count() == 0
    text = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "i string, x double")
    assert [r.a for r in Series(text, [], "i").compute(a=lambda s: ops.cum_sum(s, "x")).orderBy("i").collect()] == [1, 3, 7]


@pytest.mark.parametrize("limit", [50, 100_000])
def test_selection_equals_sorting(spark, limit):
    rng = np.random.default_rng(2)
    groups = {
        "wide": np.concatenate([rng.standard_normal(6000) * 10.0 ** rng.integers(-5, 200, 6000), np.full(3000, 3.25)]), "few": rng.integers(0, 5, 3000).astype(float), None: np.array([1.0, 4.0]),
        "nan": np.array([1.0, math.nan]), "one": np.array([7.5]), "infinite": np.array([-math.inf, 1, 2, math.inf]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "k string, x double").repartition(4)
    qs = {"low": 0.0, "tenth": 0.1, "median": 0.5, "most": 0.777, "high": 1.0}
    found = {r.k: r for r in quantiles(df, ["k"], "x", qs, limit).collect()}
    assert found.keys() == groups.keys()
    for k, x in groups.items():
        for name, q in qs.items():
            ordered, at = sorted(x), q * (len(x) - 1)
            low, high = ordered[int(at)], ordered[min(int(at) + 1, len(x) - 1)]
            want = math.nan if np.isnan(x).any() else low if at == int(at) or low == high else low + (at - int(at)) * (high - low)
            assert _near(found[k][name], float(want)), (k, name)
    few = df.where("k in ('few', 'one')")
    mads = {r.k: r.mad for r in median_abs_deviation(few, ["k"], "x", limit).collect()}
    assert mads == {"one": 0.0, "few": float(np.median(np.abs(groups["few"] - np.median(groups["few"]))))}
    whole = quantiles(few.where("k = 'few'"), [], "x", qs, limit).first()
    assert [whole[n] for n in qs] == [found["few"][n] for n in qs]
    assert quantiles(df.limit(0), [], "x", {"median": 0.5}).first()["median"] != 0 and quantiles(df.limit(0), ["k"], "x", qs).count() == 0
