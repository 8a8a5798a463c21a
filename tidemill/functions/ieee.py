"""IEEE 754 behaviour for double columns. Spark orders NaN above everything, calls it equal to itself, skips it in min and
least, raises or nulls on division by zero and nulls logarithms of what isn't positive; these wrappers do none of that.

NULL means NaN at this library's boundary: `nz` converts, and no operator returns NULL for a number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = math.inf


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def nz(x: Column | str) -> Column:
    """As double, with NULL as NaN."""
    return F.coalesce(col(x).cast("double"), F.lit(NAN))


def or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))


def no_nan(*xs: Column) -> Column:
    out = ~F.isnan(xs[0])
    for x in xs[1:]:
        out = out & ~F.isnan(x)
    return out


def gt(x, y) -> Column:
    return (col(x) > col(y)) & no_nan(col(x), col(y))


def ge(x, y) -> Column:
    return (col(x) >= col(y)) & no_nan(col(x), col(y))


def lt(x, y) -> Column:
    return gt(y, x)


def le(x, y) -> Column:
    return ge(y, x)


def eq(x, y) -> Column:
    return (col(x) == col(y)) & no_nan(col(x), col(y))


def ne(x, y) -> Column:
    return ~eq(x, y)


def _negative_zero(y: Column) -> Column:
    # 1/y isn't available for zeros; the text of a double keeps the sign.
    return y.cast("string").startswith("-")


def div(x, y) -> Column:
    """x / y with infinities and NaN for zero divisors."""
    x, y = col(x).cast("double"), col(y).cast("double")
    unsigned = F.when(F.isnan(x) | (x == 0), NAN).when(x > 0, INF).otherwise(-INF)
    return F.when(y == 0, F.when(_negative_zero(y), -unsigned).otherwise(unsigned)).otherwise(x / F.when(y != 0, y))


def _log(x: Column, zero_at: float, log: Column) -> Column:
    return F.when(F.isnan(x) | (x < zero_at), NAN).when(x == zero_at, -INF).otherwise(log)


def ln(x) -> Column:
    return _log(col(x), 0.0, F.ln(col(x)))


def log2(x) -> Column:
    return _log(col(x), 0.0, F.log2(col(x)))


def log10(x) -> Column:
    return _log(col(x), 0.0, F.log10(col(x)))


def log1p(x) -> Column:
    return _log(col(x), -1.0, F.log1p(col(x)))


def min2(x, y) -> Column:
    x, y = col(x), col(y)
    return F.when(F.isnan(x) | F.isnan(y), NAN).otherwise(F.least(x, y))


def max2(x, y) -> Column:
    return F.greatest(col(x), col(y))
