"""Elementwise arithmetic, mathematics and masks: functions from columns (or numbers) to a column. Masks are booleans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import fused, ieee
from tidemill.functions.ieee import INF, NAN, col

greater, greater_equal, less, less_equal, equal, not_equal = ieee.gt, ieee.ge, ieee.lt, ieee.le, ieee.eq, ieee.ne
#: The same against a constant.
greater_scalar, greater_equal_scalar, less_scalar, less_equal_scalar, equal_scalar, not_equal_scalar = (
    ieee.gt, ieee.ge, ieee.lt, ieee.le, ieee.eq, ieee.ne,
)
div = div_scalar = ratio_ieee = ieee.div
log, log2, log10, log1p = ieee.ln, ieee.log2, ieee.log10, ieee.log1p
min2, max2 = ieee.min2, ieee.max2


def is_nan(x) -> Column:
    return F.isnan(col(x))


def is_finite(x) -> Column:
    return ~F.isnan(col(x)) & (F.abs(col(x)) != INF)


def is_inf(x, sign: int = 0) -> Column:
    """sign > 0: positive infinity, < 0: negative, 0: either."""
    x = col(x)
    return x == INF if sign > 0 else x == -INF if sign < 0 else F.abs(x) == INF


def and_(a, b) -> Column:
    return col(a) & col(b)


def or_(a, b) -> Column:
    return col(a) | col(b)


def xor(a, b) -> Column:
    return col(a) != col(b)


def not_(a) -> Column:
    return ~col(a)


def where(cond, a, b) -> Column:
    return F.when(col(cond), col(a)).otherwise(col(b))


def add(x, y) -> Column:
    return col(x) + col(y)


def sub(x, y) -> Column:
    return col(x) - col(y)


def mul(x, y) -> Column:
    return col(x) * col(y)


add_scalar, sub_scalar, scale = add, sub, mul


def rsub_scalar(x, k: float) -> Column:
    return col(k) - col(x)


def rdiv_scalar(x, k: float) -> Column:
    return ieee.div(k, x)


def safe_div(x, y) -> Column:
    """x / y, and 0 where y is 0."""
    y = col(y)
    return F.when(y == 0, 0.0).otherwise(col(x) / F.when(y != 0, y))


def abs_(x) -> Column:
    return F.abs(col(x))


def neg(x) -> Column:
    return -col(x)


def recip(x) -> Column:
    return ieee.div(1.0, x)


def sign(x) -> Column:
    return F.signum(col(x))


def _integral(x: Column, rounded: Column) -> Column:
    """Beyond 2**52 every double is an integer, and Spark's BIGINT would saturate."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(rounded.cast("double"))


def floor(x) -> Column:
    return _integral(col(x), F.floor(col(x)))


def ceil(x) -> Column:
    return _integral(col(x), F.ceil(col(x)))


def trunc(x) -> Column:
    return _integral(col(x), F.when(col(x) < 0, F.ceil(col(x))).otherwise(F.floor(col(x))))


def round_(x) -> Column:
    """Half away from zero."""
    x = col(x)
    return _integral(x, F.when(x < 0, -F.floor(F.abs(x) + F.when(F.abs(x) - F.floor(F.abs(x)) >= 0.5, 1).otherwise(0))).otherwise(F.floor(x + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0))))


def sqrt(x) -> Column:
    return F.sqrt(col(x))


def exp(x) -> Column:
    return F.exp(col(x))


def expm1(x) -> Column:
    return F.expm1(col(x))


def pow_(x, k: float) -> Column:
    return F.pow(col(x), col(k))


def clamp(x, lo: float, hi: float) -> Column:
    x = col(x)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, col(lo)), col(hi)))


def lerp(x, y, t: float) -> Column:
    return col(x) + col(t) * (col(y) - col(x))


def mul_add(x, y, z) -> Column:
    return col(x) * col(y) + col(z)


def fma(x, y, z) -> Column:
    """x * y + z with one rounding; Catalyst has no such expression, so values go through Arrow in batches."""

    @F.pandas_udf("double")
    def exact(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(fused.fma(*[v.to_numpy(np.float64) for v in part]))

    return ieee.or_nan(exact(col(x), col(y), col(z)))


def fill(v: float) -> Column:
    return F.lit(float(v))


def copy(x) -> Column:
    return col(x)
