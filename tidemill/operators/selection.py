"""Exact order statistics of large groups, without sorting them or gathering their values.

Every pass over the rows narrows, for each group and quantile, an interval that is known to hold the wanted value: an
aggregate counts the rows below and within, and a sketch of those within gives a grid of values, of which those around the
wanted rank are the next interval. The sketch's error is far below a step of the grid, and the counts of the next pass
prove the interval or raise. A pass narrows by about a factor of a hundred; when no interval holds more than `rows` rows,
these alone are sorted. All quantiles share the passes. What an aggregate holds is a grid for each quantile, what a sort gets
is bounded by `rows`.

NULL counts as NaN, and a NaN makes a group's results NaN, as does having no rows. Ties need nothing: an interval of one value
is its answer, however many rows hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.ieee import NAN, nz
from tidemill.operators.pieces import beside, checkpointed

GRID = 256


def _grid(x: Column) -> Column:
    inner = F.percentile_approx(x, [i / GRID for i in range(1, GRID)], 100 * GRID)
    return F.concat(F.array(F.min(x)), inner, F.array(F.max(x)))


def _narrowed(grid: Column, rank: Column, rows: Column) -> tuple[Column, Column]:
    """Values of the grid around the ranks `rank` and `rank` + 1 of so many rows."""
    low, high = (F.floor((rank + k) * GRID / rows).cast("int") for k in (0, 1))
    return grid[F.greatest(low - 1, F.lit(0))], grid[F.least(high + 2, F.lit(GRID))]


def quantiles(df: DataFrame, keys: list[str], x: str | Column, qs: dict[str, float], rows: int = 100_000) -> DataFrame:
    """keys and a column for each name of `qs`: the quantile by linear interpolation between order statistics."""
    if not all(0 <= q <= 1 for q in qs.values()):
        raise ValueError("quantiles must lie in [0, 1]")
    js = range(len(qs))
    data = df.select(*keys, nz(x).alias("_x"))
    valid = F.when(~F.isnan("_x"), F.col("_x"))
    first = data.groupBy(*keys).agg(F.count("*").alias("_n"), F.coalesce(F.bool_or(F.isnan("_x")), F.lit(False)).alias("_bad"), _grid(valid).alias("_g"))
    state = first.withColumns({f"_k{j}": F.floor(F.lit(float(q)) * (F.col("_n") - 1)).cast("long") for j, q in zip(js, qs.values(), strict=True)})
    around = [_narrowed(F.col("_g"), F.col(f"_k{j}"), F.greatest("_n", F.lit(1))) for j in js]
    state = checkpointed(state.select(*keys, "_n", "_bad", *[F.col(f"_k{j}") for j in js], *[c.alias(f"_{e}{j}") for j in js for c, e in zip(around[j], ("lo", "hi"), strict=True)]))
    groups, fixed = state, [*keys, "_n", "_bad", *[f"_k{j}" for j in js]]
    while True:
        both = beside(data, state.where("not _bad and _n > 0"), keys, not keys)
        inside = {j: (F.col("_x") >= F.col(f"_lo{j}")) & (F.col("_x") <= F.col(f"_hi{j}")) for j in js}
        counts = [c for j in js for c in (F.count_if(F.col("_x") < F.col(f"_lo{j}")).alias(f"_b{j}"), F.count_if(inside[j]).alias(f"_i{j}"), _grid(F.when(inside[j], F.col("_x"))).alias(f"_g{j}"))]
        kept = [F.first(c).alias(c) for c in [c for c in state.columns if c not in keys]]
        found = checkpointed(both.groupBy(*keys).agg(*kept, *counts))
        missed = [(F.col(f"_b{j}") > F.col(f"_k{j}")) | (F.col(f"_b{j}") + F.col(f"_i{j}") <= F.least(F.col(f"_k{j}") + 1, F.col("_n") - 1)) for j in js]
        open_ = [F.when(F.col(f"_lo{j}") < F.col(f"_hi{j}"), F.col(f"_i{j}")).otherwise(0) for j in js]
        lost, most = found.agg(F.bool_or(F.greatest(*missed, F.lit(False))), F.max(F.greatest(*open_, F.lit(0)))).first()
        if lost:
            raise RuntimeError("an interval doesn't hold its value")
        if (most or 0) <= rows:
            break
        around = [_narrowed(F.col(f"_g{j}"), F.col(f"_k{j}") - F.col(f"_b{j}"), F.col(f"_i{j}")) for j in js]
        state = found.select(*fixed, *[c.alias(f"_{e}{j}") for j in js for c, e in zip(around[j], ("lo", "hi"), strict=True)])
    near = beside(data, found.select(*keys, *[c for j in js for c in (f"_lo{j}", f"_hi{j}", f"_b{j}", f"_k{j}")]), keys, not keys)
    wanted = F.array(*[F.when((F.col(f"_lo{j}") < F.col(f"_hi{j}")) & (F.col("_x") >= F.col(f"_lo{j}")) & (F.col("_x") <= F.col(f"_hi{j}")), F.struct(F.lit(j).alias("_j"), (F.col(f"_k{j}") - F.col(f"_b{j}")).alias("_rank"))) for j in js])
    listed = near.select(*keys, "_x", F.explode(F.filter(wanted, lambda w: w.isNotNull())).alias("_w"))
    place = F.row_number().over(Window.partitionBy(*keys, "_w._j").orderBy("_x")) - 1
    listed = listed.select(*keys, "_x", "_w._j", "_w._rank", place.alias("_p"))
    ranked = listed.where("_p between _rank and _rank + 1").groupBy(*keys).agg(*[c for j in js for c in (F.min(F.when(F.col("_j") == j, F.col("_x"))).alias(f"_low{j}"), F.max(F.when(F.col("_j") == j, F.col("_x"))).alias(f"_high{j}"))])
    joined = _left(groups.select(*fixed), found.select(*keys, *[c for j in js for c in (f"_lo{j}", f"_hi{j}")]), keys)
    joined = _left(joined, ranked, keys)
    out = []
    for j, (name, q) in zip(js, qs.items(), strict=True):
        one = F.col(f"_lo{j}") == F.col(f"_hi{j}")
        low, high = (F.when(one, F.col(f"_lo{j}")).otherwise(F.col(f"_{e}{j}")) for e in ("low", "high"))
        part = F.lit(float(q)) * (F.col("_n") - 1) - F.col(f"_k{j}")
        value = F.when((part == 0) | (low == high), low).otherwise(low + part * (high - low))
        out.append(F.when(F.col("_bad") | (F.col("_n") == 0), NAN).otherwise(value).alias(name))
    return joined.select(*keys, *out)


def _left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """A left join of tables with a row a group, null keys included."""
    named = b.select(*[F.col(k).alias(f"_same{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_same{i}"))
    return a.join(named, same, "left").drop(*[f"_same{i}" for i in range(len(keys))])


def median_abs_deviation(df: DataFrame, keys: list[str], x: str | Column, rows: int = 100_000) -> DataFrame:
    """keys, mad: the median of the distances from the median, without a consistency factor."""
    data = df.select(*keys, nz(x).alias("_v"))
    near = beside(data, quantiles(data, keys, "_v", {"_c": 0.5}, rows), keys, not keys)
    infinite = F.abs(F.col("_c")) == float("inf")
    return quantiles(near, keys, F.when(infinite, NAN).otherwise(F.abs(F.col("_v") - F.col("_c"))), {"mad": 0.5}, rows)
