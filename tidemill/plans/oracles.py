"""DuckDB SQL that states each indicator anew, for comparison with the Spark operators.

A statement is a chain of steps over `s0` (hourly bars with their position i): each step adds columns. Recurrences with
constant weights are written in closed form over prefix sums, state machines as recursive tables. Where a value isn't
available yet it is NULL; results are rounded to six places, shifted a little so that no exact half is on an edge."""

from __future__ import annotations

BARS = """b AS (
  SELECT event_type, date_trunc('hour', ts) AS bar_ts, arg_min(value, event_id) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2
), s0 AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bar_ts) - 1 AS i FROM b
)"""
W = "PARTITION BY event_type ORDER BY bar_ts"
SHIFT = "0.000000033"


def rounded(e: str) -> str:
    return f"round(CASE WHEN isnan(({e})::DOUBLE) THEN NULL ELSE ({e})::DOUBLE END + {SHIFT}, 6) + 0.0"


def agg(f: str, x: str, n: int, first: int = 0) -> str:
    """f over the last n rows, once they all are at or after row `first`."""
    return f"CASE WHEN i >= {first + n - 1} THEN {f}({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"


def avg(x: str, n: int, first: int = 0) -> str:
    return agg("avg", x, n, first)


def total(x: str, n: int, first: int = 0) -> str:
    return agg("sum", x, n, first)


def hi(x: str, n: int, first: int = 0) -> str:
    return agg("max", x, n, first)


def lo(x: str, n: int, first: int = 0) -> str:
    return agg("min", x, n, first)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def run(x: str) -> str:
    return f"sum({x}) OVER ({W} ROWS UNBOUNDED PRECEDING)"


def smooth(x: str, a: float, n: int, first: int) -> str:
    """y = a * x + (1 - a) * y, from the mean of rows first to first + n - 1: the sum of all terms, each with its weight."""
    s = first + n - 1
    keep = repr(1 - a)
    return (
        f"CASE WHEN i >= {s} THEN pow({keep}, i - {s}) * (avg(CASE WHEN i BETWEEN {first} AND {s} THEN {x} END) OVER (PARTITION BY event_type)"
        f" + {a!r} * sum(CASE WHEN i > {s} THEN ({x}) * pow({keep}, {s} - i) ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING)) END"
    )


def ema(x: str, n: int, first: int = 0) -> str:
    return smooth(x, 2 / (n + 1), n, first)


def rma(x: str, n: int, first: int = 0) -> str:
    return smooth(x, 1 / n, n, first)


def over0(num: str, den: str, neutral: str = "0") -> str:
    return f"CASE WHEN ({den}) IS NULL OR ({num}) IS NULL THEN NULL WHEN ({den}) = 0 THEN {neutral} ELSE ({num}) / ({den}) END"


def weights(x: str, ws: list[float]) -> str:
    n = len(ws)
    return f"CASE WHEN i >= {n - 1} THEN " + " + ".join(f"{w!r} * lag({x}, {n - 1 - j}) OVER ({W})" for j, w in enumerate(ws)) + " END"


TR = "CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (" + W + ")), abs(low - lag(close) OVER (" + W + "))) END"
TP = "(high + low + close) / 3"
HL2 = "(high + low) / 2"


def statement(*steps: dict[str, str], raw: tuple[str, ...] = (), tables: str = "", source: str = "s0") -> str:
    """The last step has the results; `raw` of them aren't rounded. `tables` go between s0 and the steps."""
    parts, now = [BARS], source
    if tables:
        parts.append(tables)
    for k, step in enumerate(steps[:-1], 1):
        parts.append(f"t{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {now})")
        now = f"t{k}"
    out = ", ".join(f"{e} AS {n}" if n in raw else f"{rounded(e)} AS {n}" for n, e in steps[-1].items())
    recursive = "RECURSIVE " if "UNION ALL" in tables else ""
    return f"WITH {recursive}{', '.join(parts)}\nSELECT event_type, bar_ts, {out} FROM {now}"


def recursion(state: dict[str, tuple[str, str]], source: str = "z") -> str:
    """A table r of states by row: for each name its value at row 0 (of columns n.*) and later (of r.* before and n.*)."""
    names = ", ".join(state)
    first = ", ".join(f"({a})::DOUBLE AS {n}" for n, (a, _) in state.items())
    later = ", ".join(f"({b})::DOUBLE AS {n}" for n, (_, b) in state.items())
    return (
        f"r AS (SELECT n.event_type, n.bar_ts, n.i, {first} FROM {source} n WHERE n.i = 0 UNION ALL "
        f"SELECT n.event_type, n.bar_ts, n.i, {later} FROM r JOIN {source} n ON n.event_type = r.event_type AND n.i = r.i + 1), "
        f"rr AS (SELECT event_type, bar_ts, i, {names} FROM r)"
    )


def linreg(n: int) -> dict[str, str]:
    """Window sums for regression of close on position."""
    f = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return {
        "slope": f"CASE WHEN i >= {n - 1} THEN regr_slope(close, i) {f} END",
        "mean": f"CASE WHEN i >= {n - 1} THEN avg(close) {f} END",
        "syy": f"CASE WHEN i >= {n - 1} THEN {n} * var_pop(close) {f} END",
        "sxy": f"CASE WHEN i >= {n - 1} THEN {n} * covar_pop(close, i) {f} END",
    }
