"""The registered queries: each operator on the driver tables, with SQL that states it independently.

Indicators run on hourly bars derived from `events` (key event_type, order bar_ts), series operators on the events' own
values. Doubles are rounded on both sides; NaN is shown as NULL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import indicators as ta
from tidemill.operators.series import Series
from tidemill.plans import oracles as q
from tidemill.plans.oracles import agg, avg, ema, hi, lag, lo, over0, rma, run, statement, total, weights
from tidemill.sources.bars import bars

SHIFT = float(q.SHIFT)


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, NaN as NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), F.round(c + SHIFT, 6) + 0.0).alias(f.name)
        out.append(c)
    return df.select(*out)


def bar_series(spark: SparkSession, sf_dir: str) -> Series:
    return Series(bars(spark.read.parquet(f"{sf_dir}/events.parquet")), ["event_type"], "bar_ts")


def _on_bars(name: str, op: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = bar_series(spark, sf_dir).compute(**{name: op})
        return shown(found.drop("open", "high", "low", "close", "volume"))

    return query


HLC = ("high", "low", "close")
OHLC = ("open", "high", "low", "close")

#: name: (operator, SQL or None)
INDICATORS: dict[str, tuple[Callable, str | None]] = {}


def _add(name: str, op: Callable, *steps: dict[str, str], **kw) -> None:
    """steps: those of oracles.statement; a single value is named like the operator, others name_key."""
    if steps:
        last = {name if k == "" else f"{name}_{k}": e for k, e in steps[-1].items()}
        kw["raw"] = tuple(f"{name}_{k}" if k else name for k in kw.get("raw", ()))
        INDICATORS[name] = (op, statement(*steps[:-1], last, **kw))
    else:
        INDICATORS[name] = (op, None)


def _register() -> None:
    c = "close"
    _add("median_price", lambda s: ta.median_price(s, "high", "low"), {"": q.HL2})
    _add("typical_price", lambda s: ta.typical_price(s, *HLC), {"": q.TP})
    _add("average_price", lambda s: ta.average_price(s, *OHLC), {"": "(open + high + low + close) / 4"})
    _add("weighted_close", lambda s: ta.weighted_close(s, *HLC), {"": "(high + low + 2 * close) / 4"})
    _add("true_range", lambda s: ta.true_range(s, *HLC), {"": q.TR})
    _add("change", lambda s: ta.change(s, c, 3), {"": f"close - {lag(c, 3)}"})
    _add("sma", lambda s: ta.sma(s, c, 20), {"": avg(c, 20)})
    _add("ema", lambda s: ta.ema(s, c, 20), {"": ema(c, 20)})
    _add("rma", lambda s: ta.rma(s, c, 14), {"": rma(c, 14)})
    _add("wma", lambda s: ta.wma(s, c, 9), {"": weights(c, [(j + 1) / 45 for j in range(9)])})
    e1, e2, e3 = {"e1": ema(c, 10)}, {"e2": ema("e1", 10, 9)}, {"e3": ema("e2", 10, 18)}
    e4, e5, e6 = {"e4": ema("e3", 10, 27)}, {"e5": ema("e4", 10, 36)}, {"e6": ema("e5", 10, 45)}
    _add("dema", lambda s: ta.dema(s, c, 10), e1, e2, {"": "2 * e1 - e2"})
    _add("tema", lambda s: ta.tema(s, c, 10), e1, e2, e3, {"": "3 * e1 - 3 * e2 + e3"})
    v = 0.7
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + 3 * v**2 + v**3
    _add("t3", lambda s: ta.t3(s, c, 10, 0.7), e1, e2, e3, e4, e5, e6, {"": f"{c1} * e6 + {c2} * e5 + {c3} * e4 + {c4} * e3"})
    _add("trix", lambda s: ta.trix(s, c, 10), e1, e2, e3, {"p": lag("e3")}, {"": over0("100 * (e3 - p)", "p")})
    _add("trima", lambda s: ta.trima(s, c, 10), {"m": avg(c, 5)}, {"": avg("m", 6, 4)})
    w4, w9 = weights(c, [(j + 1) / 10 for j in range(4)]), weights(c, [(j + 1) / 45 for j in range(9)])
    _add("hma", lambda s: ta.hma(s, c, 9), {"a": w4, "b": w9}, {"d": "2 * a - b"}, {"": weights("d", [1 / 6, 2 / 6, 3 / 6])})
    raw = [math.exp(-((j - 0.85 * 8) ** 2) / (2 * (9 / 6) ** 2)) for j in range(9)]
    _add("alma", lambda s: ta.alma(s, c, 9, 0.85, 6.0), {"": weights(c, [x / sum(raw) for x in raw])})
    _add("swma", lambda s: ta.swma(s, c), {"": weights(c, [1 / 6, 2 / 6, 2 / 6, 1 / 6])})
    ham = [0.54 - 0.46 * math.cos(2 * math.pi * k / 9) for k in range(10)]
    _add("hamming_ma", lambda s: ta.hamming_ma(s, c, 10), {"": weights(c, [x / sum(ham) for x in ham])})
    _add("zlema", lambda s: ta.zlema(s, c, 11), {"d": f"2 * close - {lag(c, 5)}"}, {"": ema("d", 11, 5)})
    move = {"d": f"close - {lag(c)}"}
    kama = q.recursion({"v": ("'nan'", "CASE WHEN n.i < 10 THEN 'nan' WHEN n.i = 10 THEN n.close ELSE r.v + pow(CASE WHEN n.vol = 0 THEN 0 ELSE abs(n.close - n.base) / n.vol END * (2.0/3 - 2.0/31) + 2.0/31, 2) * (n.close - r.v) END")})
    z = f"y AS (SELECT *, abs(close - {lag(c)}) AS m FROM s0), z AS (SELECT *, {total('m', 10, 1)} AS vol, {lag(c, 10)} AS base FROM y), "
    _add("kama", lambda s: ta.kama(s, c, 10, 2, 30), {"": "v"}, tables=z + kama, source="rr")
    up, down = f"greatest(close - {lag(c)}, 0)", f"greatest({lag(c)} - close, 0)"
    sums = {"g": f"CASE WHEN i > 0 THEN {up} END", "l": f"CASE WHEN i > 0 THEN {down} END"}
    both = {"p": total("g", 9, 1), "m": total("l", 9, 1)}
    cmo = over0("100 * (p - m)", "p + m")
    _add("cmo", lambda s: ta.cmo(s, c, 9), sums, both, {"": cmo})
    z = f"x AS (SELECT *, {sums['g']} AS g, {sums['l']} AS l FROM s0), y AS (SELECT *, {both['p']} AS p, {both['m']} AS m FROM x), z AS (SELECT *, {cmo} AS k FROM y), "
    vidya = q.recursion({"v": ("'nan'", "CASE WHEN n.i < 9 THEN 'nan' WHEN n.i = 9 THEN n.close ELSE n.close * (2.0/15) * abs(n.k) / 100 + (1 - (2.0/15) * abs(n.k) / 100) * r.v END")})
    _add("vidya", lambda s: ta.vidya(s, c, 14, 9), {"": "v"}, tables=z + vidya, source="rr")
    mcg = q.recursion({"v": ("n.close + 5000", "CASE WHEN isnan(r.v) OR r.v = 0 OR pow((n.close + 5000) / r.v, 4) = 0 THEN 'nan' ELSE r.v + (n.close + 5000 - r.v) / (0.6 * 10 * pow((n.close + 5000) / r.v, 4)) END")}, "s0")
    _add("mcginley_dynamic", lambda s: ta.mcginley_dynamic(s, F.col(c) + 5000, 10), {"": "v"}, tables=mcg, source="rr")
    periods = {f"short_{k}": n for k, n in enumerate((3, 5, 8, 10, 12, 15))} | {f"long_{k}": n for k, n in enumerate((30, 35, 40, 45, 50, 60))}

    def gmma(s: Series):
        lines = yield from ta.gmma(s, c)
        return {k: lines[k.split("_")[0]][int(k[-1])] for k in periods}

    _add("gmma", gmma, {k: ema(c, n) for k, n in periods.items()})

    _add("highest", lambda s: ta.highest(s, "high", 20), {"": hi("high", 20)})
    _add("lowest", lambda s: ta.lowest(s, "low", 20), {"": lo("low", 20)})
    top, bottom = hi("high", 20), lo("low", 20)
    _add("donchian", lambda s: ta.donchian(s, "high", "low", 20), {"a": top, "b": bottom}, {"upper": "a", "middle": "(a + b) / 2", "lower": "b"})
    _add("fifty_two_week_high_low", lambda s: ta.fifty_two_week_high_low(s, "high", "low", 52), {"highs": hi("high", 52), "lows": lo("low", 52)})
    _add("moving_average_envelope", lambda s: ta.moving_average_envelope(s, c, 20, 0.025), {"m": avg(c, 20)}, {"upper": "m * 1.025", "middle": "m", "lower": "m * 0.975"})
    _add("moving_average_channel", lambda s: ta.moving_average_channel(s, "high", "low", 20), {"upper": avg("high", 20), "lower": avg("low", 20)})
    tr = {"tr": q.TR}
    _add("atr", lambda s: ta.atr(s, *HLC, 14), tr, {"": rma("tr", 14)})
    bb = {"m": avg(c, 20), "sd": agg("stddev_pop", c, 20)}
    _add("bollinger_bands", lambda s: ta.bollinger_bands(s, c, 20, 2.0), bb, {"upper": "m + 2 * sd", "middle": "m", "lower": "m - 2 * sd"})
    _add("bb_percent_b", lambda s: ta.bb_percent_b(s, c, 20, 2.0), bb, {"": over0("close - m + 2 * sd", "4 * sd")})
    _add("bb_width", lambda s: ta.bb_width(s, c, 20, 2.0), bb, {"": over0("4 * sd", "m")})
    _add("keltner_channels", lambda s: ta.keltner_channels(s, *HLC, 20, 10, 2.0), tr, {"m": ema(c, 20), "a": rma("tr", 10)}, {"upper": "m + 2 * a", "middle": "m", "lower": "m - 2 * a"})
    _add("chaikin_volatility", lambda s: ta.chaikin_volatility(s, "high", "low", 10), {"e": ema("high - low", 10)}, {"p": lag("e", 10)}, {"": over0("100 * (e - p)", "p")})
    ret = {"r": f"CASE WHEN i > 0 THEN ln(close / {lag(c)}) END"}
    _add("historical_volatility", lambda s: ta.historical_volatility(s, c, 20, 252.0), ret, {"": f"100 * {agg('stddev_pop', 'r', 20, 1)} * sqrt(252)".replace("100 * CASE", "100 * (CASE").replace("END * sqrt", "END) * sqrt")})
    _add("volatility_ohlc", lambda s: ta.volatility_ohlc(s, *OHLC, 20, 252.0), {"g": "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"}, {"a": avg("g", 20)}, {"": "CASE WHEN a IS NOT NULL THEN 100 * sqrt(greatest(a, 0) * 252) END"})

    def rsi(x: str, n: int, first: int) -> tuple[dict, dict, str]:
        d = f"({x} - {lag(x)})"
        moves = {f"g_{x}": f"CASE WHEN i > {first} THEN greatest({d}, 0) END", f"l_{x}": f"CASE WHEN i > {first} THEN greatest(-{d}, 0) END"}
        means = {f"u_{x}": rma(f"g_{x}", n, first + 1), f"d_{x}": rma(f"l_{x}", n, first + 1)}
        u, v = f"u_{x}", f"d_{x}"
        return moves, means, f"CASE WHEN {u} = 0 AND {v} = 0 THEN 50 WHEN {v} = 0 THEN 100 WHEN {u} = 0 THEN 0 ELSE 100 - 100 / (1 + {u} / {v}) END"

    r1, r2_, r3 = rsi("close", 14, 0)
    _add("rsi", lambda s: ta.rsi(s, c, 14), r1, r2_, {"": r3})
    line = {"m": f"({ema(c, 12)}) - ({ema(c, 26)})"}
    _add("macd", lambda s: ta.macd(s, c, 12, 26, 9), line, {"g": ema("m", 9, 25)}, {"macd": "m", "signal": "g", "hist": "m - g"})
    k_raw = {"k0": over0("100 * (close - b)", "a - b", "50")}
    _add("stochastic", lambda s: ta.stochastic(s, *HLC, 14, 3, 3), {"a": hi("high", 14), "b": lo("low", 14)}, k_raw, {"k": avg("k0", 3, 13)}, {"k": "k", "d": avg("k", 3, 15)})
    _add("stoch_rsi", lambda s: ta.stoch_rsi(s, c, 14, 14, 3, 3), r1, r2_, {"x": r3}, {"a": hi("x", 14, 14), "b": lo("x", 14, 14)}, {"k0": over0("100 * (x - b)", "a - b", "50")}, {"k": avg("k0", 3, 27)}, {"k": "k", "d": avg("k", 3, 29)})
    _add("williams_percent_r", lambda s: ta.williams_percent_r(s, *HLC, 14), {"a": hi("high", 14), "b": lo("low", 14)}, {"": over0("-100 * (a - close)", "a - b")})
    dev = " + ".join(f"abs(lag(tp, {j}) OVER ({q.W}) - m)" for j in range(14))
    _add("cci", lambda s: ta.cci(s, *HLC, 14), {"tp": q.TP}, {"m": avg("tp", 14)}, {"d": f"({dev}) / 14"}, {"": over0("tp - m", "0.015 * d")})
    _add("roc", lambda s: ta.roc(s, c, 12), {"p": lag(c, 12)}, {"": over0("100 * (close - p)", "p")})
    _add("momentum", lambda s: ta.momentum(s, c, 10), {"": f"close - {lag(c, 10)}"})
    below = " + ".join(f"CASE WHEN lag(close, {j}) OVER ({q.W}) < close THEN 1 ELSE 0 END" for j in range(1, 20))
    _add("percent_rank", lambda s: ta.percent_rank(s, c, 20), {"": f"CASE WHEN i >= 19 THEN 100.0 * ({below}) / 20 END"})
    hl = {"a": hi("high", 10), "b": lo("low", 10)}
    _add("stochastic_momentum_index", lambda s: ta.stochastic_momentum_index(s, *HLC, 10, 3, 5), hl, {"x": "close - (a + b) / 2", "y": "a - b"}, {"x1": ema("x", 3, 9), "y1": ema("y", 3, 9)}, {"x2": ema("x1", 3, 11), "y2": ema("y1", 3, 11)}, {"smi": over0("100 * x2", "y2")}, {"smi": "smi", "signal": ema("smi", 5, 13)})
    _add("relative_volatility_index", lambda s: ta.relative_volatility_index(s, c, 10), {"sd": agg("stddev_pop", c, 10), "p": lag(c)}, {"u": "CASE WHEN close > p THEN sd ELSE 0 END", "v": "CASE WHEN close < p THEN sd ELSE 0 END"}, {"us": rma("u", 10, 9), "vs": rma("v", 10, 9)}, {"": over0("100 * us", "us + vs", "50")})
    s1, s2, s3 = rsi("k", 2 + 1, 1)
    below = " + ".join(f"CASE WHEN lag(o, {j}) OVER ({q.W}) < o THEN 1 ELSE 0 END" for j in range(1, 30))
    streak = q.recursion({"k": ("'nan'", "CASE WHEN n.close > n.p THEN CASE WHEN r.k > 0 AND NOT isnan(r.k) THEN r.k + 1 ELSE 1 END WHEN n.close < n.p THEN CASE WHEN r.k < 0 THEN r.k - 1 ELSE -1 END ELSE 0 END")})
    z = f"z AS (SELECT *, {lag(c)} AS p FROM s0), "
    joined = f", j AS (SELECT z.*, CASE WHEN isnan(k) THEN NULL ELSE k END AS k, 100 * (close - p) / p AS o FROM z JOIN rr USING (event_type, bar_ts, i))"
    _add("connors_rsi", lambda s: ta.connors_rsi(s, c, 3, 3, 30), *[a | b for a, b in zip(rsi("close", 3, 0)[:2], (s1, s2), strict=True)], {"": f"CASE WHEN i >= 30 THEN ({rsi('close', 3, 0)[2]} + {s3} + 100.0 * ({below}) / 30) / 3 END"}, tables=z + streak + joined, source="j")
    _add("elder_ray", lambda s: ta.elder_ray(s, *HLC, 13), {"e": ema(c, 13)}, {"bull": "high - e", "bear": "low - e"})

    vol = "volume"
    _add("vwap", lambda s: ta.vwap(s, *HLC, vol), {"": f"{run(q.TP + ' * volume')} / {run(vol)}"})
    _add("vwma", lambda s: ta.vwma(s, c, vol, 20), {"a": total("close * volume", 20), "b": total(vol, 20)}, {"": over0("a", "b")})
    signed = f"CASE WHEN close > {lag(c)} THEN volume WHEN close < {lag(c)} THEN -volume ELSE 0 END"
    _add("obv", lambda s: ta.obv(s, c, vol), {"v": signed}, {"": run("v")})
    _add("net_volume", lambda s: ta.net_volume(s, c, vol), {"": signed})
    mfv = {"f": "CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END"}
    _add("accumulation_distribution", lambda s: ta.accumulation_distribution(s, *HLC, vol), mfv, {"": run("f")})
    _add("chaikin_money_flow", lambda s: ta.chaikin_money_flow(s, *HLC, vol, 20), mfv, {"a": total("f", 20), "b": total(vol, 20)}, {"": over0("a", "b")})
    _add("chaikin_oscillator", lambda s: ta.chaikin_oscillator(s, *HLC, vol, 3, 10), mfv, {"ad": run("f")}, {"": f"({ema('ad', 3)}) - ({ema('ad', 10)})"})
    _add("money_flow_index", lambda s: ta.money_flow_index(s, *HLC, vol, 14), {"tp": q.TP}, {"p": lag("tp")}, {"u": "CASE WHEN tp > p THEN tp * volume ELSE 0 END", "v": "CASE WHEN tp < p THEN tp * volume ELSE 0 END"}, {"us": total("u", 14, 1), "vs": total("v", 14, 1)}, {"": "CASE WHEN us = 0 AND vs = 0 THEN 50 WHEN vs = 0 THEN 100 ELSE 100 - 100 / (1 + us / vs) END"})
    _add("price_volume_trend", lambda s: ta.price_volume_trend(s, c, vol), {"p": lag(c)}, {"v": "CASE WHEN p IS NULL OR p = 0 THEN 0 ELSE (close - p) / p * volume END"}, {"": run("v")})
    _add("volume_oscillator", lambda s: ta.volume_oscillator(s, vol, 5, 10), {"a": avg(vol, 5), "b": avg(vol, 10)}, {"": over0("100 * (a - b)", "b")})
    _add("force_index", lambda s: ta.force_index(s, c, vol, 13), {"f": f"(close - {lag(c)}) * volume"}, {"": ema("f", 13, 1)})
    _add("balance_of_power", lambda s: ta.balance_of_power(s, *OHLC, 14), {"r": "CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END"}, {"": avg("r", 14)})
    _add("ease_of_movement", lambda s: ta.ease_of_movement(s, "high", "low", vol, 14), {"mid": q.HL2}, {"e": f"CASE WHEN high = low OR volume = 0 THEN 0 ELSE (mid - {lag('mid')}) * (high - low) / volume END"}, {"": avg("e", 14, 1)})
    _add("relative_volume", lambda s: ta.relative_volume(s, vol, 20), {"a": avg(vol, 20)}, {"": over0("volume", "a")})
    way = "CASE WHEN n.tp < n.p THEN -1 ELSE 1 END"
    kvo = q.recursion({"trend": ("0", way), "cm": ("0", f"CASE WHEN r.trend = 0 THEN n.dm WHEN r.trend = {way} THEN r.cm + n.dm ELSE n.pdm + n.dm END"), "vf": ("'nan'", f"CASE WHEN (CASE WHEN r.trend = 0 THEN n.dm WHEN r.trend = {way} THEN r.cm + n.dm ELSE n.pdm + n.dm END) = 0 THEN 0 ELSE n.volume * abs(2 * (n.dm / (CASE WHEN r.trend = 0 THEN n.dm WHEN r.trend = {way} THEN r.cm + n.dm ELSE n.pdm + n.dm END) - 1)) * {way} * 100 END")})
    z = f"z AS (SELECT *, high + low + close AS tp, {lag('high + low + close')} AS p, high - low AS dm, {lag('high - low')} AS pdm FROM s0), "
    _add("klinger_oscillator", lambda s: ta.klinger_oscillator(s, *HLC, vol, 10, 20, 5), {"f": "CASE WHEN isnan(vf) THEN NULL ELSE vf END"}, {"k": f"({ema('f', 10, 1)}) - ({ema('f', 20, 1)})"}, {"kvo": "k", "signal": ema("k", 5, 20)}, tables=z + kvo, source="rr")

    dm = {"up": f"high - {lag('high')}", "dn": f"{lag('low')} - low", "tr": q.TR}
    dm2 = {"pd": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "md": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"}
    dm3 = {"p": rma("pd", 14, 1), "m": rma("md", 14, 1), "a": rma("tr", 14)}
    dm4 = {"pdi": over0("100 * p", "a"), "mdi": over0("100 * m", "a")}
    dm5 = {"dx": over0("100 * abs(pdi - mdi)", "pdi + mdi")}
    _add("directional_movement", lambda s: ta.directional_movement(s, *HLC, 14), dm, dm2, dm3, dm4, dm5, {"adx": rma("dx", 14, 14), "plus_di": "pdi", "minus_di": "mdi"})
    since = lambda x, f: f"list_min(list_transform(range(25), lambda j: CASE WHEN l_{x}[25 - j] = list_{f}(l_{x}) THEN j ELSE 99 END))"
    arrays = {f"l_{x}": f"CASE WHEN i >= 24 THEN list({x}) OVER ({q.W} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) END" for x in ("high", "low")}
    _add("aroon", lambda s: ta.aroon(s, "high", "low", 25), arrays, {"u": f"CASE WHEN i >= 24 THEN 100.0 * (25 - {since('high', 'max')}) / 25 END", "d": f"CASE WHEN i >= 24 THEN 100.0 * (25 - {since('low', 'min')}) / 25 END"}, {"up": "u", "down": "d", "osc": "u - d"})
    _add("vortex", lambda s: ta.vortex(s, *HLC, 14), {"vp": f"abs(high - {lag('low')})", "vm": f"abs(low - {lag('high')})", "tr": q.TR}, {"p": total("vp", 14, 1), "m": total("vm", 14, 1), "t": total("tr", 14)}, {"plus": over0("p", "t"), "minus": over0("m", "t")})
    _add("choppiness", lambda s: ta.choppiness(s, *HLC, 14), tr, {"t": total("tr", 14), "sp": f"({hi('high', 14)}) - ({lo('low', 14)})"}, {"": "CASE WHEN sp <= 0 THEN 0 ELSE 100 * log10(t / sp) / log10(14) END"})
    z = f"y AS (SELECT *, {q.TR} AS tr FROM s0), z AS (SELECT *, {rma('tr', 10)} AS a, {lag(c)} AS pc FROM y), "
    ub, lb = "(n.high + n.low) / 2 + 3 * n.a", "(n.high + n.low) / 2 - 3 * n.a"
    fu = f"CASE WHEN n.i < 9 THEN 'nan' WHEN n.i = 9 THEN {ub} WHEN {ub} < r.fu OR n.pc > r.fu THEN {ub} ELSE r.fu END"
    fl = f"CASE WHEN n.i < 9 THEN 'nan' WHEN n.i = 9 THEN {lb} WHEN {lb} > r.fl OR n.pc < r.fl THEN {lb} ELSE r.fl END"
    trend = f"CASE WHEN n.i <= 9 THEN 1 WHEN r.tr = 1 AND n.close < ({fl})::DOUBLE THEN -1 WHEN r.tr = -1 AND n.close > ({fu})::DOUBLE THEN 1 ELSE r.tr END"
    _add("supertrend", lambda s: ta.supertrend(s, *HLC, 10, 3.0), {"line": "CASE WHEN i < 9 THEN NULL WHEN tr = 1 THEN fl ELSE fu END", "direction": "CASE WHEN i >= 9 THEN tr END"}, tables=z + q.recursion({"fu": ("'nan'", fu), "fl": ("'nan'", fl), "tr": ("1", trend)}), source="rr")
    cur = "(r.sar + r.af * (r.ep - r.sar))"
    flip = f"(CASE WHEN r.up = 1 THEN n.low < {cur} ELSE n.high > {cur} END)"
    up2 = f"(CASE WHEN {flip} THEN -r.up ELSE r.up END)"
    base = f"(CASE WHEN {flip} THEN r.ep ELSE {cur} END)"
    far = "(CASE WHEN r.up = 1 THEN n.high > r.ep ELSE n.low < r.ep END)"
    z = f"z AS (SELECT *, {lag('low')} AS l1, {lag('low', 2)} AS l2, {lag('high')} AS h1, {lag('high', 2)} AS h2 FROM s0), "
    sar = q.recursion({
        "up": ("1", up2),
        "af": ("0.02", f"CASE WHEN {flip} THEN 0.02 WHEN {far} THEN least(r.af + 0.02, 0.2) ELSE r.af END"),
        "ep": ("n.high", f"CASE WHEN {flip} THEN CASE WHEN r.up = 1 THEN n.low ELSE n.high END WHEN {far} THEN CASE WHEN r.up = 1 THEN n.high ELSE n.low END ELSE r.ep END"),
        "sar": ("n.low", f"CASE WHEN {up2} = 1 THEN least({base}, n.l1, coalesce(n.l2, n.l1)) ELSE greatest({base}, n.h1, coalesce(n.h2, n.h1)) END"),
    })
    _add("parabolic_sar", lambda s: ta.parabolic_sar(s, "high", "low", 0.02, 0.02, 0.2), {"sar": "sar", "direction": "up"}, tables=z + sar, source="rr")
    rise = "greatest(r.run, n.high)"
    fall = "least(r.run, n.low)"
    top_hit, low_hit = f"(r.up = 1 AND n.low <= {rise} * 0.95)", f"(r.up = 0 AND n.high >= {fall} * 1.05)"
    zz = q.recursion({
        "up": ("1", f"CASE WHEN {top_hit} THEN 0 WHEN {low_hit} THEN 1 ELSE r.up END"),
        "run": ("n.high", f"CASE WHEN {top_hit} THEN n.low WHEN {low_hit} THEN n.high WHEN r.up = 1 THEN {rise} ELSE {fall} END"),
        "piv": ("n.low", f"CASE WHEN {top_hit} THEN {rise} WHEN {low_hit} THEN {fall} ELSE r.piv END"),
        "sort": ("-1", f"CASE WHEN {top_hit} THEN 1 WHEN {low_hit} THEN -1 ELSE r.sort END"),
    }, "s0")
    _add("zig_zag", lambda s: ta.zig_zag(s, "high", "low", 0.05), {"pivot": "piv", "kind": "sort::TINYINT"}, tables=zz, source="rr", raw=("kind",))

    reg = q.linreg(14)
    se = {"rest": "CASE WHEN syy IS NOT NULL THEN greatest(syy - sxy * sxy / 227.5, 0) END"}
    _add("linear_regression", lambda s: ta.linear_regression(s, c, 14), reg, {"": "mean + slope * 6.5"})
    _add("linear_regression_slope", lambda s: ta.linear_regression_slope(s, c, 14), reg, {"": "slope"})
    _add("linear_regression_intercept", lambda s: ta.linear_regression_intercept(s, c, 14), reg, {"": "mean - slope * 6.5"})
    _add("r2", lambda s: ta.r2(s, c, 14), reg, {"": over0("sxy * sxy", "227.5 * syy")})
    _add("standard_error", lambda s: ta.standard_error(s, c, 14), reg, se, {"": "sqrt(rest / 12)"})
    _add("standard_error_bands", lambda s: ta.standard_error_bands(s, c, 14, 2.0), reg, se, {"upper": "mean + slope * 6.5 + 2 * sqrt(rest / 12)", "middle": "mean + slope * 6.5", "lower": "mean + slope * 6.5 - 2 * sqrt(rest / 12)"})

    ao = f"({avg(q.HL2, 5)}) - ({avg(q.HL2, 34)})"
    _add("awesome_oscillator", lambda s: ta.awesome_oscillator(s, "high", "low", 5, 34), {"": ao})
    _add("accelerator_oscillator", lambda s: ta.accelerator_oscillator(s, "high", "low", 5, 34, 5), {"ao": ao}, {"": f"ao - ({avg('ao', 5, 33)})"})
    _add("detrended_price_oscillator", lambda s: ta.detrended_price_oscillator(s, c, 20), {"": f"{lag(c, 11)} - ({avg(c, 20)})"})
    bp = {"bp": f"CASE WHEN i > 0 THEN close - least(low, {lag(c)}) END", "t": f"CASE WHEN i > 0 THEN greatest(high, {lag(c)}) - least(low, {lag(c)}) END"}
    uo = {f"{x}{n}": total(x, n, 1) for n in (7, 14, 28) for x in ("bp", "t")}
    _add("ultimate_oscillator", lambda s: ta.ultimate_oscillator(s, *HLC, 7, 14, 28), bp, uo, {"": f"CASE WHEN i >= 28 THEN 100 * (4 * {over0('bp7', 't7')} + 2 * {over0('bp14', 't14')} + {over0('bp28', 't28')}) / 7 END"})
    z = f"y AS (SELECT *, {hi('high', 10)} AS a, {lo('low', 10)} AS b FROM s0), z AS (SELECT *, {over0('(high + low) / 2 - b', 'a - b', '0.5')} AS p FROM y), "
    val = "least(greatest(0.66 * (n.p - 0.5) + 0.67 * r.v, -0.999), 0.999)"
    fish = q.recursion({"v": ("0", f"CASE WHEN n.i < 9 THEN 0 ELSE {val} END"), "f": ("0", f"CASE WHEN n.i < 9 THEN 0 ELSE 0.5 * ln((1 + {val}) / (1 - {val})) + 0.5 * r.f END")})
    _add("fisher_transform", lambda s: ta.fisher_transform(s, "high", "low", 10), {"": "CASE WHEN i >= 9 THEN f END"}, tables=z + fish, source="rr")
    _add("mass_index", lambda s: ta.mass_index(s, "high", "low", 9, 25), {"a": ema("high - low", 9), "b": ema("high - low", 25)}, {"r": over0("a", "b")}, {"": total("r", 25, 24)})
    _add("price_oscillator", lambda s: ta.price_oscillator(s, c, 12, 26), {"a": avg(c, 12), "b": avg(c, 26)}, {"": "100 * (a - b) / b"})

    f20 = f"OVER ({q.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    corr = lambda x, y, n, first: f"CASE WHEN i >= {first + n - 1} AND stddev_pop({x}) {f20} > 0 AND stddev_pop({y}) {f20} > 0 THEN covar_pop({x}, {y}) {f20} / (stddev_pop({x}) {f20} * stddev_pop({y}) {f20}) END"
    _add("correlation_coefficient", lambda s: ta.correlation_coefficient(s, c, vol, 20), {"": corr("close", "volume", 20, 0)})
    _add("correlation_log", lambda s: ta.correlation_log(s, c, "high", 20), {"a": f"ln(close / {lag(c)})", "h": f"ln(high / {lag('high')})"}, {"": corr("a", "h", 20, 1)})
    rk = lambda l, j: f"(len(list_filter({l}, lambda x: x < {l}[{j}])) + (len(list_filter({l}, lambda x: x = {l}[{j}])) + 1) / 2.0 - 5.5)"
    lists = {"xs": f"CASE WHEN i >= 9 THEN list(close) OVER ({q.W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END", "ys": f"CASE WHEN i >= 9 THEN list(volume) OVER ({q.W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END"}
    ranks = {f"r{x}": f"CASE WHEN i >= 9 THEN [{', '.join(rk(x + 's', j) for j in range(1, 11))}] ELSE [0.0] END" for x in "xy"}
    _add("rank_correlation", lambda s: ta.rank_correlation(s, c, vol, 10), lists, ranks, {"xy": "list_inner_product(rx, ry)", "xx": "list_inner_product(rx, rx)", "yy": "list_inner_product(ry, ry)"}, {"": "CASE WHEN i >= 9 AND xx > 0 AND yy > 0 THEN xy / sqrt(xx * yy) END"})
    _add("standard_deviation", lambda s: ta.standard_deviation(s, c, 20), {"": agg("stddev_pop", c, 20)})
    _add("ratio", lambda s: ta.ratio(s, c, "open"), {"": "CASE WHEN open = 0 THEN 0 ELSE close / open END"})
    _add("spread", lambda s: ta.spread(s, c, "open"), {"": "close - open"})
    ro = lambda n: over0(f"100 * (close - {lag(c, n)})", lag(c, n))
    _add("coppock_curve", lambda s: ta.coppock_curve(s, c, 14, 11, 10), {"t": f"({ro(14)}) + ({ro(11)})"}, {"": weights("t", [(j + 1) / 55 for j in range(10)])})
    ks = {f"r{n}": ro(n) for n in (10, 15, 20, 30)}
    kst = {"k": f"({avg('r10', 10, 10)}) + 2 * ({avg('r15', 10, 15)}) + 3 * ({avg('r20', 10, 20)}) + 4 * ({avg('r30', 15, 30)})"}
    _add("know_sure_thing", lambda s: ta.know_sure_thing(s, c, (10, 15, 20, 30), (10, 10, 10, 15), 9), ks, kst, {"kst": "k", "signal": avg("k", 9, 44)})
    tsi = ({"d": f"close - {lag(c)}"}, {"a1": ema("d", 25, 1), "b1": ema("abs(d)", 25, 1)}, {"a2": ema("a1", 13, 25), "b2": ema("b1", 13, 25)}, {"t": over0("100 * a2", "b2")})
    _add("true_strength_index", lambda s: ta.true_strength_index(s, c, 25, 13), *tsi, {"": "t"})
    _add("smi_ergodic", lambda s: ta.smi_ergodic(s, c, 25, 13, 5), *tsi, {"g": ema("t", 5, 37)}, {"ergodic": "t", "signal": "g", "oscillator": "t - g"})
    _add("williams_alligator", lambda s: ta.williams_alligator(s, "high", "low", (13, 8), (8, 5), (5, 3)), {"a": rma(q.HL2, 13), "b": rma(q.HL2, 8), "d": rma(q.HL2, 5)}, {"jaw": lag("a", 8), "teeth": lag("b", 5), "lips": lag("d", 3)})
    ext = lambda f, x, op: " AND ".join(f"lag({x}, 2) OVER ({q.W}) {op} lag({x}, {j}) OVER ({q.W})" for j in (0, 1, 3, 4))
    _add("williams_fractal", lambda s: ta.williams_fractal(s, "high", "low", 2), {"up": f"coalesce({ext('max', 'high', '>')}, false)", "down": f"coalesce({ext('min', 'low', '<')}, false)"}, raw=("up", "down"))
    mid = lambda n: f"(({hi('high', n)}) + ({lo('low', n)})) / 2"
    _add("ichimoku", lambda s: ta.ichimoku(s, *HLC, 9, 26, 52, 26), {"a": mid(9), "b": mid(26), "sb": mid(52)}, {"conversion": "a", "base": "b", "span_a": lag("(a + b) / 2", 26), "span_b": lag("sb", 26), "lagging": f"lead(close, 26) OVER ({q.W})"})
    p3, pw = "(high + low + close) / 3", "(high + low + 2 * close) / 4"
    for method, levels in {
        "classic": {"pivot": p3, "r1": f"2 * {p3} - low", "s1": f"2 * {p3} - high", "r2": f"{p3} + high - low", "s2": f"{p3} - high + low", "r3": f"high + 2 * ({p3} - low)", "s3": f"low - 2 * (high - {p3})"},
        "fibonacci": {"pivot": p3} | {f"{a}{k}": f"{p3} {o} {m} * (high - low)" for a, o in (("r", "+"), ("s", "-")) for k, m in ((1, 0.382), (2, 0.618), (3, 1))},
        "camarilla": {"pivot": p3} | {f"{a}{k}": f"close {o} (high - low) * 1.1 / {m}" for a, o in (("r", "+"), ("s", "-")) for k, m in ((1, 12), (2, 6), (3, 4))},
        "woodie": {"pivot": pw, "r1": f"2 * {pw} - low", "s1": f"2 * {pw} - high", "r2": f"{pw} + high - low", "s2": f"{pw} - high + low", "r3": f"high + 2 * ({pw} - low)", "s3": f"low - 2 * (high - {pw})"},
    }.items():
        kind = ta.PivotMethod(method.title())
        order = ("pivot", "r1", "r2", "r3", "s1", "s2", "s3")
        _add(f"pivot_levels_{method}", lambda s, kind=kind: ta.pivot_levels(*HLC, kind), {k: levels[k] for k in order})
        _add(f"pivot_points_{method}", lambda s, kind=kind: ta.pivot_points(s, *HLC, kind), {f"x_{k}": levels[k] for k in order}, {k: lag(f"x_{k}") for k in order})
    _add("chande_kroll_stop", lambda s: ta.chande_kroll_stop(s, *HLC, 10, 1.5, 9), tr, {"a": rma("tr", 10), "h": hi("high", 10), "l": lo("low", 10)}, {"u": "h - 1.5 * a", "v": "l + 1.5 * a"}, {"long": hi("u", 9, 9), "short": lo("v", 9, 9)})
    sw = {"o1": lag("open"), "c1": lag(c)}
    sw2 = {"hc": "abs(high - c1)", "lc": "abs(low - c1)", "co": "abs(c1 - o1)", "k": "greatest(high, c1) - least(low, c1)"}
    sw3 = {"r": "CASE WHEN hc >= lc AND hc >= high - low THEN hc - 0.5 * lc WHEN lc >= hc AND lc >= high - low THEN lc - 0.5 * hc ELSE high - low END + 0.25 * co"}
    sw4 = {"si": "CASE WHEN i = 0 OR r = 0 THEN 0 ELSE 50 * (close - c1 + 0.5 * (close - open) + 0.25 * (c1 - o1)) / r * (k / 300) END"}
    _add("swing_index", lambda s: ta.swing_index(s, *OHLC, 300.0), sw, sw2, sw3, sw4, {"": "si"})
    _add("accumulative_swing_index", lambda s: ta.accumulative_swing_index(s, *OHLC, 300.0), sw, sw2, sw3, sw4, {"": run("si")})
    _add("relative_vigor_index", lambda s: ta.relative_vigor_index(s, *OHLC, 10, 4), {"r": "high - low"}, {"v": "CASE WHEN r = 0 THEN 0 ELSE (close - open) / r END"}, {"a": total("v", 10), "b": total("r", 10)}, {"x": over0("a", "b")}, {"rvi": "x", "signal": ema("x", 4, 9)})
    _add("chop_zone", lambda s: ta.chop_zone(s, *HLC, 14), {"u": f"CASE WHEN i > 0 THEN greatest(high - {lag(c)}, 0) END", "d": f"CASE WHEN i > 0 THEN greatest({lag(c)} - low, 0) END"}, {"us": total("u", 14, 1), "ds": total("d", 14, 1)}, {"": "CASE WHEN us > 0 AND ds > 0 THEN 100 * log10(us / ds) / log10(14) END"})
    _add("advance_decline", lambda s: ta.advance_decline(s, "high", "low"), {"": run("high - low")})
    x_ing = "CASE WHEN pa <= pb AND a > b THEN 1 WHEN pa >= pb AND a < b THEN -1 ELSE 0 END::TINYINT"
    for name, f, a, b in (("ma_cross", ta.ma_cross, avg(c, 10), avg(c, 30)), ("ema_cross", ta.ema_cross, ema(c, 10), ema(c, 30)), ("ema_sma_cross", ta.ema_sma_cross, ema(c, 10), avg(c, 30))):
        _add(name, lambda s, f=f: f(s, c, 10, 30), {"a": a, "b": b}, {"pa": lag("a"), "pb": lag("b")}, {"fast": "a", "slow": "b", "cross": f"({x_ing})"}, raw=("cross",))
    del move


_register()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemill.plans import kernels_catalogue

    out = {f"bars_{'bollinger' if n == 'bollinger_bands' else n}": _on_bars(n, op) for n, (op, _) in INDICATORS.items()}
    return out | kernels_catalogue.queries()


def oracle_sql() -> dict[str, str]:
    from tidemill.plans import kernels_catalogue

    out = {f"bars_{'bollinger' if n == 'bollinger_bands' else n}": sql for n, (_, sql) in INDICATORS.items() if sql}
    return out | kernels_catalogue.oracle_sql()
