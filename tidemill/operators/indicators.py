"""Technical indicators over ordered bars. Each is a function of a `Series` and columns, for `Series.compute`; those with
several outputs return a dict. Windows are trailing and counted in rows; what isn't available yet is NaN; each indicator's
own neutral value for a zero divisor is in its docstring. Recurrences run as kernels, everything else as window expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Sequence
from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import ieee
from tidemill.functions.ieee import INF, NAN, col, gt, lt, no_nan, or_nan
from tidemill.operators import kernels
from tidemill.operators import series as ops
from tidemill.operators.series import Kernel, Running, Series, check_period, ema_kernel, rma_kernel, weighted_kernel, wma_kernel

NEUTRAL_ZERO = 0.0


def ratio_or(num: Column, den: Column, neutral: float) -> Column:
    """num / den, `neutral` for a zero divisor, NaN where either is NaN."""
    return F.when(~no_nan(num, den), NAN).when(den == 0, neutral).otherwise(num / F.when(den != 0, den))


def _machine(step: Callable[..., tuple], begin: list[float], inputs: list, outputs: int = 1) -> Kernel:
    return Kernel(lambda: kernels.Machine(step, begin), inputs, outputs, machine=True)


# Prices


def median_price(s: Series, high, low) -> Column:
    return (col(high) + col(low)) / 2


def typical_price(s: Series, high, low, close) -> Column:
    return (col(high) + col(low) + col(close)) / 3


def average_price(s: Series, open, high, low, close) -> Column:
    return (col(open) + col(high) + col(low) + col(close)) / 4


def weighted_close(s: Series, high, low, close) -> Column:
    return (col(high) + col(low) + 2 * col(close)) / 4


def true_range(s: Series, high, low, close) -> Column:
    """The first bar, and one after a NaN close, has its own range."""
    before, own = s.back(close, 1), col(high) - col(low)
    up, down = F.abs(col(high) - before), F.abs(col(low) - before)
    wider = F.when(gt(up, own), up).otherwise(own)
    return F.when(gt(down, wider), down).otherwise(wider)


def change(s: Series, x, n: int) -> Column:
    return ops.diff(s, x, n)


# Moving averages


def sma(s: Series, x, n: int) -> Column:
    return s.mean(x, n)


def ema(s: Series, x, n: int) -> Generator:
    return (yield ema_kernel(x, n))


def rma(s: Series, x, n: int) -> Generator:
    return (yield rma_kernel(x, n))


def wma(s: Series, x, n: int) -> Generator:
    return (yield wma_kernel(x, n))


def _chained(n: int, times: int) -> Callable[[], kernels.Chain]:
    """EMAs of EMAs."""
    check_period(n)
    return lambda: kernels.Chain(2 / (n + 1), n, times)


def dema(s: Series, x, n: int) -> Generator:
    check_period(n)
    e1, e2 = yield Kernel(_chained(n, 2), [x], 2)
    return 2 * e1 - e2


def tema(s: Series, x, n: int) -> Generator:
    check_period(n)
    e1, e2, e3 = yield Kernel(_chained(n, 3), [x], 3)
    return 3 * e1 - 3 * e2 + e3


def t3(s: Series, x, n: int, v: float) -> Generator:
    """Terms with a zero coefficient are left out, so that their longer warm-up doesn't matter."""
    check_period(n)
    if not 0 <= v <= 1:
        raise ValueError("v must lie in [0, 1]")
    e = yield Kernel(_chained(n, 6), [x], 6)
    terms = ((-(v**3), e[5]), (3 * v**2 + 3 * v**3, e[4]), (-6 * v**2 - 3 * v - 3 * v**3, e[3]), (1 + 3 * v + 3 * v**2 + v**3, e[2]))
    total = F.lit(0.0)
    for c, values in terms:
        total = total + c * values if c else total
    return total


def trima(s: Series, x, n: int) -> Generator:
    check_period(n)
    inner = yield s.mean(x, (n + 1) // 2)
    return s.mean(inner, n // 2 + 1)


def hma(s: Series, x, n: int) -> Generator:
    check_period(n)
    half, whole = yield [wma_kernel(x, max(1, n // 2)), wma_kernel(x, n)]
    raw = yield 2 * half - whole
    return (yield wma_kernel(raw, max(1, math.floor(math.sqrt(n) + 0.5))))


def alma(s: Series, x, n: int, offset: float, sigma: float) -> Generator:
    check_period(n)
    if not 0 <= offset <= 1 or sigma <= 0:
        raise ValueError("offset must lie in [0, 1] and sigma be positive")
    centre, width = offset * (n - 1), n / sigma
    weights = [math.exp(-((j - centre) ** 2) / (2 * width * width)) for j in range(n)]
    return (yield weighted_kernel(x, [w / sum(weights) for w in weights]))


def swma(s: Series, x) -> Generator:
    return (yield weighted_kernel(x, [1 / 6, 2 / 6, 2 / 6, 1 / 6]))


def hamming_ma(s: Series, x, n: int) -> Generator:
    check_period(n)
    weights = [1.0] if n == 1 else [0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]
    return (yield weighted_kernel(x, [w / sum(weights) for w in weights]))


def zlema(s: Series, x, n: int) -> Generator:
    check_period(n)
    lag = (n - 1) // 2
    ahead = yield 2 * col(x) - s.back(x, lag)
    return (yield ema_kernel(ahead, n, lag))


def kama(s: Series, x, n: int, fast: int, slow: int) -> Generator:
    for p in (n, fast, slow):
        check_period(p)
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    moved = yield F.abs(col(x) - s.back(x, 1))
    volatility, before = yield [s.sum(moved, n), s.back(x, n)]
    quick, calm = 2 / (fast + 1), 2 / (slow + 1)

    def gain(row: np.ndarray, x: np.ndarray, v: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = np.divide(np.abs(x - base), v, out=np.zeros(len(x)), where=v != 0)
        bad = np.isnan(v) | np.isnan(x) | np.isnan(base)
        return row == n, np.where(bad, np.nan, (share * (quick - calm) + calm) ** 2)

    return (yield Kernel(lambda: kernels.Adaptive(gain), [x, volatility, before]))


def vidya(s: Series, x, n: int, cmo_period: int) -> Generator:
    check_period(n)
    strength = yield from cmo(s, x, cmo_period)
    strength = yield strength
    gain = lambda row, x, c: (~np.isnan(c), 2 / (n + 1) * np.abs(c) / 100)
    return (yield Kernel(lambda: kernels.Adaptive(gain), [x, strength]))


def mcginley_dynamic(s: Series, x, n: int) -> Generator:
    check_period(n)

    def step(held: list[float], x: float) -> tuple:
        begun, value = held
        if not begun:
            held[:] = 1.0, x
            return (x,)
        ratio = x / value if value and value == value and x == x else 0.0
        divisor = 0.6 * n * ratio * ratio * ratio * ratio
        held[1] = value = value + (x - value) / divisor if divisor else NAN
        return (value,)

    return (yield _machine(step, [0, NAN], [x]))


def gmma(s: Series, close) -> Generator:
    """Twelve EMAs; two arrays."""
    short, long = (3, 5, 8, 10, 12, 15), (30, 35, 40, 45, 50, 60)
    lines = yield [ema_kernel(close, n) for n in (*short, *long)]
    return {"short": F.array(*lines[:6]), "long": F.array(*lines[6:])}


# Extremes and channels


def highest(s: Series, x, n: int) -> Generator:
    return (yield ops.max_kernel(x, n))


def lowest(s: Series, x, n: int) -> Generator:
    return (yield ops.min_kernel(x, n))


def donchian(s: Series, high, low, n: int) -> Generator:
    top, bottom = yield [ops.max_kernel(high, n), ops.min_kernel(low, n)]
    return {"upper": top, "middle": (top + bottom) / 2, "lower": bottom}


def fifty_two_week_high_low(s: Series, high, low, bars: int) -> Generator:
    highs, lows = yield [ops.max_kernel(high, bars), ops.min_kernel(low, bars)]
    return {"highs": highs, "lows": lows}


def moving_average_envelope(s: Series, x, n: int, percent: float) -> dict:
    """percent is a fraction."""
    if not percent >= 0:
        raise ValueError("percent must not be negative")
    middle = s.mean(x, n)
    return {"upper": middle * (1 + percent), "middle": middle, "lower": middle * (1 - percent)}


def moving_average_channel(s: Series, high, low, n: int) -> dict:
    return {"upper": s.mean(high, n), "lower": s.mean(low, n)}


# Volatility


def atr(s: Series, high, low, close, n: int) -> Generator:
    tr = yield true_range(s, high, low, close)
    return (yield rma_kernel(tr, n))


def bollinger_bands(s: Series, close, n: int, k: float) -> dict:
    middle, spread = s.mean(close, n), s.agg(F.stddev_pop(col(close)), n)
    return {"upper": middle + k * spread, "middle": middle, "lower": middle - k * spread}


def bb_percent_b(s: Series, close, n: int, k: float) -> Column:
    """Zero width: 0."""
    b = bollinger_bands(s, close, n, k)
    return ratio_or(col(close) - b["lower"], b["upper"] - b["lower"], 0.0)


def bb_width(s: Series, close, n: int, k: float) -> Column:
    """Zero middle: 0."""
    b = bollinger_bands(s, close, n, k)
    return ratio_or(b["upper"] - b["lower"], b["middle"], 0.0)


def keltner_channels(s: Series, high, low, close, n: int, atr_n: int, mult: float) -> Generator:
    tr = yield true_range(s, high, low, close)
    middle, reach = yield [ema_kernel(close, n), rma_kernel(tr, atr_n)]
    return {"upper": middle + mult * reach, "middle": middle, "lower": middle - mult * reach}


def chaikin_volatility(s: Series, high, low, n: int) -> Generator:
    """Zero base: 0."""
    spread = yield col(high) - col(low)
    smooth = yield ema_kernel(spread, n)
    base = s.back(smooth, n)
    return ratio_or(100 * (smooth - base), base, 0.0)


def _log_returns(s: Series, x) -> Column:
    """ln(x / before); NaN on a zero base."""
    before = s.back(x, 1)
    return F.when(before == 0, NAN).otherwise(ieee.ln(col(x) / F.when(before != 0, before)))


def historical_volatility(s: Series, close, n: int, annual: float) -> Generator:
    returns = yield _log_returns(s, close)
    return s.warm(n + 1, 100 * F.stddev_pop(returns).over(s.frame(n)) * math.sqrt(annual))


def volatility_ohlc(s: Series, open, high, low, close, n: int, annual: float) -> Generator:
    """Garman and Klass; a bar whose low or open isn't positive is NaN, a negative mean counts as 0."""
    bad = ~no_nan(col(high), col(low)) | (col(low) <= 0) | (col(open) <= 0)
    spread, move = ieee.ln(ieee.div(high, low)), ieee.ln(ieee.div(close, open))
    one = yield F.when(bad, NAN).otherwise(0.5 * spread * spread - (2 * math.log(2) - 1) * move * move)
    level = yield s.mean(one, n)
    return 100 * F.sqrt(F.when(level < 0, 0.0).otherwise(level) * annual)


# Momentum


def rsi_kernel(n: int) -> Callable[[], kernels.Strength]:
    check_period(n)
    return lambda: kernels.Strength(n)


def rsi(s: Series, close, n: int) -> Generator:
    """No moves: 50; no falls: 100; no rises: 0."""
    return (yield Kernel(rsi_kernel(n), [close]))


def macd(s: Series, close, fast: int, slow: int, signal: int) -> Generator:
    check_period(signal)
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    quick, calm = yield [ema_kernel(close, fast), ema_kernel(close, slow)]
    line = yield quick - calm
    smooth = yield ema_kernel(line, signal, None)
    return {"macd": line, "signal": smooth, "hist": line - smooth}


def _raw_stochastic(s: Series, high, low, close, n: int) -> Column:
    top, bottom = s.max(high, n), s.min(low, n)
    return F.when(~no_nan(top, bottom), NAN).otherwise(ratio_or(100 * (col(close) - bottom), top - bottom, 50.0))


def stochastic(s: Series, high, low, close, k_period: int, k_smooth: int, d_smooth: int) -> Generator:
    """Flat window: 50."""
    raw = yield _raw_stochastic(s, high, low, close, k_period)
    k = yield s.mean(raw, k_smooth)
    return {"k": k, "d": s.mean(k, d_smooth)}


def stoch_rsi(s: Series, close, rsi_period: int, stoch_period: int, k_smooth: int, d_smooth: int) -> Generator:
    r = yield Kernel(rsi_kernel(rsi_period), [close])
    return (yield from stochastic(s, r, r, r, stoch_period, k_smooth, d_smooth))


def williams_percent_r(s: Series, high, low, close, n: int) -> Column:
    """Flat window: 0."""
    top, bottom = s.max(high, n), s.min(low, n)
    return ratio_or(-100 * (top - col(close)), top - bottom, 0.0)


def cci(s: Series, high, low, close, n: int) -> Generator:
    """No deviation, and also a NaN in the window: 0."""
    price = yield typical_price(s, high, low, close)
    mean, dev = yield [ops.mean_kernel(price, n), ops.abs_deviation_kernel(price, n)]
    value = F.when(F.isnan(dev) | (dev == 0), 0.0).otherwise((price - mean) / (0.015 * F.when(dev != 0, dev)))
    return s.warm(n, value)


def cmo(s: Series, close, n: int) -> Generator:
    """No moves: 0."""
    check_period(n)
    move = col(close) - s.back(close, 1)
    up, down = yield [F.when(F.isnan(move), NAN).otherwise(F.greatest(move, F.lit(0.0))), F.when(F.isnan(move), NAN).otherwise(F.greatest(-move, F.lit(0.0)))]
    rises, falls = s.sum(up, n), s.sum(down, n)
    return ratio_or(100 * (rises - falls), rises + falls, 0.0)


def roc(s: Series, close, n: int) -> Column:
    """Zero base: 0."""
    return 100 * ops.rate(s, close, n)


def momentum(s: Series, close, n: int) -> Column:
    return ops.diff(s, close, n)


def percent_rank(s: Series, x, n: int) -> Generator:
    return ops.rolling_percent_rank(s, x, n)


def stochastic_momentum_index(s: Series, high, low, close, n: int, smooth_k: int, smooth_d: int) -> Generator:
    """Zero range: 0."""
    top, bottom = s.max(high, n), s.min(low, n)
    raw, spread = yield [col(close) - (top + bottom) / 2, F.when(F.isnan(col(close)), NAN).otherwise(top - bottom)]
    a, b = yield [ema_kernel(raw, smooth_k, None), ema_kernel(spread, smooth_k, None)]
    a, b = yield [ema_kernel(a, smooth_k, None), ema_kernel(b, smooth_k, None)]
    smi = yield ratio_or(100 * a, b, 0.0)
    return {"smi": smi, "signal": (yield ema_kernel(smi, smooth_d, None))}


def relative_volatility_index(s: Series, close, n: int) -> Generator:
    """No spread on either side: 50."""
    spread = yield s.agg(F.stddev_pop(col(close)), n)
    before = s.back(close, 1)
    known = no_nan(spread, col(close), before)
    up, down = yield [
        F.when(~known, NAN).when(col(close) > before, spread).otherwise(0.0),
        F.when(~known, NAN).when(col(close) < before, spread).otherwise(0.0),
    ]
    # Both begin at the first valid spread, and not before the second bar.
    u, d = yield Kernel(lambda: kernels.FromMarker(1 / n, n, 2), [spread, up, down], 2)
    return F.when(~no_nan(u, d), NAN).otherwise(ratio_or(100 * u, u + d, 50.0))


def connors_rsi(s: Series, close, rsi_period: int, streak_period: int, rank_period: int) -> Generator:
    """Mean of the RSI of prices, the RSI of streaks and the percent rank of one-bar changes."""
    for p in (rsi_period, streak_period, rank_period):
        check_period(p)
    moves = yield roc(s, close, 1)
    streak, price = yield [Kernel(kernels.Streak, [close]), Kernel(rsi_kernel(rsi_period), [close])]
    streaks = yield Kernel(rsi_kernel(streak_period), [streak])
    rank = yield ops.percent_rank_kernel(moves, rank_period)
    return (price + streaks + rank) / 3


def elder_ray(s: Series, high, low, close, n: int) -> Generator:
    middle = yield ema_kernel(close, n)
    return {"bull": col(high) - middle, "bear": col(low) - middle}


# Volume


def vwap(s: Series, high, low, close, volume) -> Generator:
    """From the series' start; no volume: 0."""
    paid, sold = yield [Running("sum", (col(high) + col(low) + col(close)) / 3 * col(volume)), Running("sum", col(volume))]
    return ratio_or(paid, sold, 0.0)


def vwma(s: Series, close, volume, n: int) -> Column:
    """No volume: 0."""
    return ratio_or(s.sum(col(close) * col(volume), n), s.sum(volume, n), 0.0)


def _signed_volume(s: Series, close, volume) -> Column:
    before = s.lag(close)
    return F.when(before.isNull(), 0.0).when(~no_nan(col(close), before), NAN).when(col(close) > before, col(volume)).when(col(close) < before, -col(volume)).otherwise(0.0)


def obv(s: Series, close, volume) -> Generator:
    signed = yield _signed_volume(s, close, volume)
    return (yield Running("sum", signed))


def net_volume(s: Series, close, volume) -> Column:
    return _signed_volume(s, close, volume)


def _money_flow_volume(high, low, close, volume) -> Column:
    span = col(high) - col(low)
    share = ((col(close) - col(low)) - (col(high) - col(close))) / F.when(span != 0, span)
    return F.when(F.isnan(span) | (span == 0), 0.0).otherwise(share * col(volume))


def accumulation_distribution(s: Series, high, low, close, volume) -> Generator:
    """A bar without range adds 0."""
    return (yield Running("sum", _money_flow_volume(high, low, close, volume)))


def chaikin_money_flow(s: Series, high, low, close, volume, n: int) -> Column:
    """No volume: 0."""
    return ratio_or(s.sum(_money_flow_volume(high, low, close, volume), n), s.sum(volume, n), 0.0)


def chaikin_oscillator(s: Series, high, low, close, volume, fast: int, slow: int) -> Generator:
    line = yield from accumulation_distribution(s, high, low, close, volume)
    quick, calm = yield [ema_kernel(line, fast), ema_kernel(line, slow)]
    return quick - calm


def money_flow_index(s: Series, high, low, close, volume, n: int) -> Generator:
    """No flow: 50; no outflow: 100."""
    price = yield typical_price(s, high, low, close)
    before = s.back(price, 1)
    bad, flow = ~no_nan(price, before), price * col(volume)
    first = s.lag(price).isNull()
    up, down = yield [
        F.when(first | bad, NAN).when(price > before, flow).otherwise(0.0),
        F.when(first | bad, NAN).when(price < before, flow).otherwise(0.0),
    ]
    p, q = s.sum(up, n), s.sum(down, n)
    value = F.when(~no_nan(p, q), NAN).when((p == 0) & (q == 0), 50.0).when(q == 0, 100.0)
    return value.otherwise(100 - 100 / (1 + p / F.when(q != 0, q)))


def price_volume_trend(s: Series, close, volume) -> Generator:
    """A zero base adds 0."""
    before = s.lag(close)
    part = yield F.when(before.isNull() | (before == 0), 0.0).otherwise((col(close) - before) / F.when(before != 0, before) * col(volume))
    return (yield Running("sum", part))


def volume_oscillator(s: Series, volume, fast: int, slow: int) -> Column:
    """No slow mean: 0."""
    a, b = s.mean(volume, fast), s.mean(volume, slow)
    return ratio_or(100 * (a - b), b, 0.0)


def force_index(s: Series, close, volume, n: int) -> Generator:
    raw = yield (col(close) - s.back(close, 1)) * col(volume)
    return (yield ema_kernel(raw, n, 1))


def balance_of_power(s: Series, open, high, low, close, n: int) -> Column:
    """A bar without range counts as 0."""
    span = col(high) - col(low)
    return s.mean(F.when(F.isnan(span) | (span == 0), 0.0).otherwise((col(close) - col(open)) / F.when(span != 0, span)), n)


def ease_of_movement(s: Series, high, low, volume, n: int) -> Generator:
    """No range or volume: 0."""
    span, mid = col(high) - col(low), (col(high) + col(low)) / 2
    move = mid - s.back(mid, 1)
    none = (span == 0) | (col(volume) == 0)
    one = yield F.when(~no_nan(span, move, col(volume)), NAN).when(none, 0.0).otherwise(move * span / F.when(col(volume) != 0, col(volume)))
    return s.mean(one, n)


def klinger_oscillator(s: Series, high, low, close, volume, fast: int, slow: int, signal: int) -> Generator:
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    force = yield Kernel(kernels.VolumeForce, [high, low, close, volume], machine=True)
    quick, calm = yield [ema_kernel(force, fast, 1), ema_kernel(force, slow, 1)]
    line = yield quick - calm
    return {"kvo": line, "signal": (yield ema_kernel(line, signal, None))}


def relative_volume(s: Series, volume, n: int) -> Column:
    """No mean volume: 0."""
    return ratio_or(col(volume), s.mean(volume, n), 0.0)


# Trend


def directional_movement(s: Series, high, low, close, n: int) -> Generator:
    """No true range: DI 0; no DI: DX 0. Moves are smoothed from the second bar on, the range from the first."""
    check_period(n)
    up, down = col(high) - s.back(high, 1), s.back(low, 1) - col(low)
    known = no_nan(up, down)
    plus, minus, tr = yield [
        F.when(~known, NAN).when((up > down) & (up > 0), up).otherwise(0.0),
        F.when(~known, NAN).when((down > up) & (down > 0), down).otherwise(0.0),
        true_range(s, high, low, close),
    ]
    p, m, reach = yield [rma_kernel(plus, n, 1), rma_kernel(minus, n, 1), rma_kernel(tr, n)]
    bad = ~no_nan(p, m, reach)
    plus_di, minus_di = yield [F.when(bad, NAN).otherwise(ratio_or(100 * x, reach, 0.0)) for x in (p, m)]
    dx = yield ratio_or(100 * F.abs(plus_di - minus_di), plus_di + minus_di, 0.0)
    return {"adx": (yield rma_kernel(dx, n, None)), "plus_di": plus_di, "minus_di": minus_di}


def aroon(s: Series, high, low, n: int) -> Generator:
    """Over n bars; the latest of equal extremes counts."""
    i = yield s.index()
    f = s.frame(n)
    bad = F.bool_or(F.isnan(col(high)) | F.isnan(col(low))).over(f)
    top = F.max_by(i, F.struct(col(high), i)).over(f)
    bottom = F.max_by(i, F.struct(-col(low), i)).over(f)
    up, down = (s.warm(n, F.when(~bad, 100 * (n - (i - at)) / F.lit(float(n)))) for at in (top, bottom))
    return {"up": up, "down": down, "osc": up - down}


def vortex(s: Series, high, low, close, n: int) -> Generator:
    """No true range: 0."""
    plus, minus, tr = yield [F.abs(col(high) - s.back(low, 1)), F.abs(col(low) - s.back(high, 1)), true_range(s, high, low, close)]
    total = s.sum(tr, n)
    p, m = s.sum(plus, n), s.sum(minus, n)
    bad = ~no_nan(p, m, total)
    return {"plus": F.when(bad, NAN).otherwise(ratio_or(p, total, 0.0)), "minus": F.when(bad, NAN).otherwise(ratio_or(m, total, 0.0))}


def choppiness(s: Series, high, low, close, n: int) -> Generator:
    """No span: 0."""
    tr = yield true_range(s, high, low, close)
    total, span = yield [s.sum(tr, n), s.max(high, n) - s.min(low, n)]
    return F.when(~no_nan(total, span), NAN).when(span <= 0, 0.0).otherwise(ieee.div(100 * ieee.log10(total / F.when(span > 0, span)), math.log10(n)))


def supertrend(s: Series, high, low, close, atr_n: int, mult: float) -> Generator:
    """Bands that only tighten while price respects them; direction +1 or -1."""
    reach = yield from atr(s, high, low, close, atr_n)

    def step(held: list[float], high: float, low: float, close: float, reach: float) -> tuple:
        begun, up, top, bottom, last = held
        middle, held[4] = (high + low) / 2, close
        if not begun:
            if reach != reach:
                return (NAN, NAN)
            top, bottom = middle + mult * reach, middle - mult * reach
            held[:4] = 1.0, 1.0, top, bottom
            return (bottom, 1.0)
        upper, lower = middle + mult * reach, middle - mult * reach
        if upper < top or last > top:
            top = upper
        if lower > bottom or last < bottom:
            bottom = lower
        up = not close < bottom if up else close > top
        held[1:4] = up, top, bottom
        return (bottom, 1.0) if up else (top, -1.0)

    line, direction = yield _machine(step, [0, 1, NAN, NAN, NAN], [high, low, close, reach], 2)
    return {"line": line, "direction": direction}


def parabolic_sar(s: Series, high, low, start: float, increment: float, most: float) -> Generator:
    """Begins upwards at the first low; the line never enters the range of the two bars before."""
    if increment <= 0 or most < start:
        raise ValueError("increment must be positive and most at least start")

    def step(held: list[float], high: float, low: float) -> tuple:
        begun, up, pace, far, line, *bars = held  # the last bar's high and low, and those of the one before
        if not begun:
            far, line = high, low
        else:
            line += pace * (far - line)
            if (low < line) if up else (high > line):
                up, line, far, pace = not up, far, low if up else high, start
            elif (high > far) if up else (low < far):
                far, pace = high if up else low, min(pace + increment, most)
            for h, b in (bars[:2], bars[2:]):
                if up and b < line:
                    line = b
                elif not up and h > line:
                    line = h
        held[:] = 1.0, up, pace, far, line, high, low, *bars[:2]
        return (line, 1.0 if up else -1.0)

    line, direction = yield _machine(step, [0, 1, start, *[NAN] * 6], [high, low], 2)
    return {"sar": line, "direction": direction}


def zig_zag(s: Series, high, low, deviation: float) -> Generator:
    """The last confirmed pivot and its kind (+1 high, -1 low); deviation is a fraction."""
    if deviation < 0:
        raise ValueError("deviation must not be negative")

    def step(held: list[float], high: float, low: float) -> tuple:
        begun, rising, run, pivot, kind = held
        if not begun:
            run, pivot, kind = high, low, -1.0
        elif rising:
            if high > run:
                run = high
            if low <= run * (1 - deviation):
                pivot, kind, rising, run = run, 1.0, False, low
        else:
            if low < run:
                run = low
            if high >= run * (1 + deviation):
                pivot, kind, rising, run = run, -1.0, True, high
        held[:] = 1.0, rising, run, pivot, kind
        return (pivot, kind)

    pivot, kind = yield _machine(step, [0, 1, NAN, NAN, 0], [high, low], 2)
    return {"pivot": pivot, "kind": kind.cast("byte")}


# Regression on position


def _regression(s: Series, x, n: int) -> Generator:
    """slope, value at the newest bar, centred sums (xx, xy, yy) and mean of each window: moving moments of position and value,
    whose time doesn't grow with the period."""
    check_period(n, 2)
    i = yield s.index().cast("double")
    sxx = n * (n * n - 1) / 12
    both, own, mean = yield [ops.covariance_kernel(i, x, n), ops.variance_kernel(x, n), ops.mean_kernel(x, n)]
    sxy, syy = n * both, n * own
    slope = sxy / sxx
    return slope, mean + slope * ((n - 1) / 2), sxx, sxy, syy, mean


def linear_regression(s: Series, x, n: int) -> Generator:
    return (yield from _regression(s, x, n))[1]


def linear_regression_slope(s: Series, x, n: int) -> Generator:
    return (yield from _regression(s, x, n))[0]


def linear_regression_intercept(s: Series, x, n: int) -> Generator:
    """The fitted value at the window's oldest bar."""
    slope, _, _, _, _, mean = yield from _regression(s, x, n)
    return mean - slope * ((n - 1) / 2)


def r2(s: Series, x, n: int) -> Generator:
    """Flat window: 0."""
    _, _, sxx, sxy, syy, _ = yield from _regression(s, x, n)
    top, bottom = yield [ops.max_kernel(x, n), ops.min_kernel(x, n)]
    flat = (top == bottom) | (syy == 0)
    return F.when(F.isnan(syy), NAN).when(flat, 0.0).otherwise(sxy * sxy / (sxx * F.when(syy != 0, syy)))


def _standard_error(found: tuple, n: int) -> Column:
    _, _, sxx, sxy, syy, _ = found
    rest = syy - sxy * sxy / sxx
    return F.when(F.isnan(rest), NAN).otherwise(F.sqrt(F.greatest(rest, F.lit(0.0)) / (n - 2)) if n > 2 else F.lit(0.0))


def standard_error(s: Series, x, n: int) -> Generator:
    """n = 2: 0."""
    return _standard_error((yield from _regression(s, x, n)), n)


def standard_error_bands(s: Series, x, n: int, k: float) -> Generator:
    found = yield from _regression(s, x, n)
    error = _standard_error(found, n)
    return {"upper": found[1] + k * error, "middle": found[1], "lower": found[1] - k * error}


# Oscillators


def awesome_oscillator(s: Series, high, low, fast: int, slow: int) -> Column:
    mid = median_price(s, high, low)
    return s.mean(mid, fast) - s.mean(mid, slow)


def accelerator_oscillator(s: Series, high, low, fast: int, slow: int, smooth: int) -> Generator:
    ao = yield awesome_oscillator(s, high, low, fast, slow)
    return ao - s.mean(ao, smooth)


def detrended_price_oscillator(s: Series, close, n: int) -> Column:
    return s.back(close, n // 2 + 1) - s.mean(close, n)


def trix(s: Series, close, n: int) -> Generator:
    """Zero base: 0."""
    check_period(n)
    _, _, e3 = yield Kernel(_chained(n, 3), [close], 3)
    before = s.back(e3, 1)
    return ratio_or(100 * (e3 - before), before, 0.0)


def ultimate_oscillator(s: Series, high, low, close, short: int, mid: int, long: int) -> Generator:
    """No true range in a window: 0."""
    before = s.back(close, 1)
    bottom = ieee.min2(low, before)
    pressure, spread = yield [col(close) - bottom, ieee.max2(high, before) - bottom]
    a, b, c = (F.when(~no_nan(p := s.sum(pressure, n), r := s.sum(spread, n)), NAN).otherwise(ratio_or(p, r, 0.0)) for n in (short, mid, long))
    return s.warm(long + 1, 100 * (4 * a + 2 * b + c) / 7)


def fisher_transform(s: Series, high, low, n: int) -> Generator:
    """A flat window counts as the middle."""
    top, bottom, mid = yield [s.max(high, n), s.min(low, n), median_price(s, high, low)]
    place = yield F.when(~no_nan(top, bottom, mid), NAN).otherwise(ratio_or(mid - bottom, top - bottom, 0.5))

    def step(held: list[float], p: float) -> tuple:
        wait, value, fish = held
        if wait:
            held[0] -= 1
            return (NAN,)
        value = 0.66 * (p - 0.5) + 0.67 * value
        value = min(max(value, -0.999), 0.999) if value == value else NAN
        fish = 0.5 * math.log((1 + value) / (1 - value)) + 0.5 * fish
        held[1:] = value, fish
        return (fish,)

    return (yield _machine(step, [n - 1, 0, 0], [place]))


def mass_index(s: Series, high, low, ema_period: int, sum_period: int) -> Generator:
    """The sum of EMA(range, ema_period) / EMA(range, sum_period); zero divisor: 0."""
    spread = yield col(high) - col(low)
    a, b = yield [ema_kernel(spread, ema_period), ema_kernel(spread, sum_period)]
    ratio = yield ratio_or(a, b, 0.0)
    return s.sum(ratio, sum_period)


def price_oscillator(s: Series, x, fast: int, slow: int) -> Column:
    """Zero slow mean: infinite."""
    if fast >= slow:
        raise ValueError("fast must be less than slow")
    a, b = s.mean(x, fast), s.mean(x, slow)
    return ieee.div(100 * (a - b), b)


# Statistics of windows


def correlation_coefficient(s: Series, x, y, n: int) -> Generator:
    return ops.rolling_correlation(s, x, y, n)


def correlation_log(s: Series, x, y, n: int) -> Generator:
    a, b = yield [_log_returns(s, x), _log_returns(s, y)]
    return s.warm(n + 1, (yield ops.correlation_kernel(a, b, n)))


def rank_correlation(s: Series, x, y, n: int) -> Generator:
    """Spearman with average ranks; no spread, or a NaN in the window: NaN."""
    check_period(n)
    return (yield Kernel(lambda: kernels.Window(n, kernels.moving_rank_correlation, 2), [col(x), col(y)], reach=n))


def standard_deviation(s: Series, x, n: int) -> Generator:
    return ops.rolling_std_dev(s, x, n)


def ratio(s: Series, a, b) -> Column:
    """Zero divisor: 0."""
    return F.when(col(b) == 0, 0.0).otherwise(col(a) / F.when(col(b) != 0, col(b)))


def spread(s: Series, a, b) -> Column:
    return col(a) - col(b)


# Long-period oscillators and patterns


def coppock_curve(s: Series, close, roc_long: int, roc_short: int, wma_period: int) -> Generator:
    total = yield roc(s, close, roc_long) + roc(s, close, roc_short)
    return (yield wma_kernel(total, wma_period))


def know_sure_thing(s: Series, close, rocs: Sequence[int], smas: Sequence[int], signal: int) -> Generator:
    """The documented weighted sum of smoothed rates of change, weights 1 to 4."""
    rates = yield [roc(s, close, n) for n in rocs]
    smooth = [s.mean(r, n) * (k + 1) for k, (r, n) in enumerate(zip(rates, smas, strict=True))]
    kst = yield smooth[0] + smooth[1] + smooth[2] + smooth[3]
    return {"kst": kst, "signal": s.mean(kst, signal)}


def true_strength_index(s: Series, close, long: int, short: int) -> Generator:
    """No moves: 0."""
    move = yield col(close) - s.back(close, 1)
    size = yield F.abs(move)
    a, b = yield [ema_kernel(move, long, 1), ema_kernel(size, long, 1)]
    a, b = yield [ema_kernel(a, short, None), ema_kernel(b, short, None)]
    return ratio_or(100 * a, b, 0.0)


def smi_ergodic(s: Series, close, long: int, short: int, signal: int) -> Generator:
    value = yield from true_strength_index(s, close, long, short)
    line = yield value
    smooth = yield ema_kernel(line, signal, None)
    return {"ergodic": line, "signal": smooth, "oscillator": line - smooth}


def williams_alligator(s: Series, high, low, jaw: tuple[int, int], teeth: tuple[int, int], lips: tuple[int, int]) -> Generator:
    """Each line is (period, shift); shifts go forward."""
    if min(jaw[1], teeth[1], lips[1]) < 0:
        raise ValueError("shifts must not be negative")
    mid = yield median_price(s, high, low)
    lines = yield [rma_kernel(mid, n) for n, _ in (jaw, teeth, lips)]
    return {name: s.back(line, k) for name, line, (_, k) in zip(("jaw", "teeth", "lips"), lines, (jaw, teeth, lips), strict=True)}


def williams_fractal(s: Series, high, low, n: int) -> Column | dict:
    """A strict extreme among n bars on both sides, reported n bars later; masks."""
    check_period(n)
    sides = [s.between(-2 * n, -n - 1), s.between(-n + 1, 0)]
    full = s.full(2 * n + 1)
    h, l = s.back(high, n), s.back(low, n)
    known = no_nan(h, l)
    up, down = known & full, known & full
    for side in sides:
        up = up & lt(F.max(col(high)).over(side), h)
        down = down & ~F.bool_or(F.isnan(col(low))).over(side) & gt(F.min(col(low)).over(side), l)
    return {"up": F.coalesce(up, F.lit(False)), "down": F.coalesce(down, F.lit(False))}


# Structure


def ichimoku(s: Series, high, low, close, conversion: int, base: int, span_b: int, displacement: int) -> Generator:
    """The lagging line reads `displacement` bars ahead."""
    if displacement < 0:
        raise ValueError("displacement must not be negative")
    lines = yield [(s.max(high, n) + s.min(low, n)) / 2 for n in (conversion, base, span_b)]
    lead = yield (lines[0] + lines[1]) / 2
    return {"conversion": lines[0], "base": lines[1], "span_a": s.back(lead, displacement), "span_b": s.back(lines[2], displacement), "lagging": s.back(close, -displacement)}


class PivotMethod(Enum):
    CLASSIC = "Classic"
    FIBONACCI = "Fibonacci"
    CAMARILLA = "Camarilla"
    WOODIE = "Woodie"

    def __str__(self) -> str:
        return self.value


def pivot_levels(high, low, close, method: PivotMethod) -> dict:
    """pivot, r1 to r3, s1 to s3 of one bar; columns without a series."""
    h, l, c = col(high), col(low), col(close)
    span, method = h - l, PivotMethod(method)
    p = (h + l + 2 * c) / 4 if method is PivotMethod.WOODIE else (h + l + c) / 3
    if method in (PivotMethod.FIBONACCI, PivotMethod.CAMARILLA):
        centre, steps = (p, (0.382, 0.618, 1.0)) if method is PivotMethod.FIBONACCI else (c, (1.1 / 12, 1.1 / 6, 1.1 / 4))
        ups, downs = [centre + k * span for k in steps], [centre - k * span for k in steps]
    else:
        ups, downs = [2 * p - l, p + span, h + 2 * (p - l)], [2 * p - h, p - span, l - 2 * (h - p)]
    return {"pivot": p, **{f"r{i + 1}": x for i, x in enumerate(ups)}, **{f"s{i + 1}": x for i, x in enumerate(downs)}}


def pivot_points(s: Series, high, low, close, method: PivotMethod) -> dict:
    """Levels of the bar before."""
    return pivot_levels(s.back(high, 1), s.back(low, 1), s.back(close, 1), method)


# Stops and swings


def chande_kroll_stop(s: Series, high, low, close, n: int, x: float, q: int) -> Generator:
    if not x >= 0:
        raise ValueError("x must not be negative")
    reach = yield from atr(s, high, low, close, n)
    long, short = yield [s.max(high, n) - x * reach, s.min(low, n) + x * reach]
    return {"long": s.max(long, q), "short": s.min(short, q)}


def swing_index(s: Series, open, high, low, close, limit_move: float) -> Column:
    """The first bar, and a bar without range: 0."""
    if not limit_move > 0:
        raise ValueError("limit_move must be positive")
    o, h, l, c = col(open), col(high), col(low), col(close)
    o1, c1 = s.lag(o), s.lag(c)
    hc, lc, co, span = F.abs(h - c1), F.abs(l - c1), F.abs(c1 - o1), h - l
    r = F.when((hc >= lc) & (hc >= span), hc - 0.5 * lc).when((lc >= hc) & (lc >= span), lc - 0.5 * hc).otherwise(span) + 0.25 * co
    k = F.greatest(h, c1) - F.least(l, c1)
    value = 50 * (c - c1 + 0.5 * (c - o) + 0.25 * (c1 - o1)) / F.when(r != 0, r) * (k / limit_move)
    return F.when(c1.isNull(), 0.0).when(~no_nan(o, h, l, c, o1, c1), NAN).when(r == 0, 0.0).otherwise(value)


def accumulative_swing_index(s: Series, open, high, low, close, limit_move: float) -> Generator:
    one = yield swing_index(s, open, high, low, close, limit_move)
    return (yield Running("sum", one))


# The rest


def relative_vigor_index(s: Series, open, high, low, close, n: int, signal: int) -> Generator:
    """The sum of each bar's (close - open) / range over the sum of ranges; zero divisor: 0; the signal is an EMA."""
    span = yield col(high) - col(low)
    vigour = yield F.when(F.isnan(span) | (span == 0), 0.0).otherwise((col(close) - col(open)) / F.when(span != 0, span))
    rvi = yield ratio_or(s.sum(vigour, n), s.sum(span, n), 0.0)
    return {"rvi": rvi, "signal": (yield ema_kernel(rvi, signal, None))}


def chop_zone(s: Series, high, low, close, n: int) -> Generator:
    """A zero sum on either side, or n = 1: NaN."""
    before = s.back(close, 1)
    up, down = yield [ieee.max2(col(high) - before, F.lit(0.0)), ieee.max2(before - col(low), F.lit(0.0))]
    u, d = yield [s.sum(up, n), s.sum(down, n)]
    if n == 1:
        return F.lit(NAN)
    return F.when(~no_nan(u, d) | (u == 0) | (d == 0), NAN).otherwise(100 * ieee.log10(u / F.when(d != 0, d)) / math.log10(n))


def advance_decline(s: Series, advances, declines) -> Generator:
    return (yield Running("sum", col(advances) - col(declines)))


def _crossed(s: Series, fast: Column, slow: Column) -> dict:
    return {"fast": fast, "slow": slow, "cross": ops.cross(s, fast, slow)}


def _faster(fast: int, slow: int) -> None:
    if fast >= slow:
        raise ValueError("fast must be less than slow")


def ma_cross(s: Series, close, fast: int, slow: int) -> Generator:
    _faster(fast, slow)
    a, b = yield [s.mean(close, fast), s.mean(close, slow)]
    return _crossed(s, a, b)


def ema_cross(s: Series, close, fast: int, slow: int) -> Generator:
    _faster(fast, slow)
    a, b = yield [ema_kernel(close, fast), ema_kernel(close, slow)]
    return _crossed(s, a, b)


def ema_sma_cross(s: Series, close, fast: int, slow: int) -> Generator:
    _faster(fast, slow)
    a, b = yield [ema_kernel(close, fast), s.mean(close, slow)]
    return _crossed(s, a, b)


__all__ = [n for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")]
_ = (INF, or_nan)
