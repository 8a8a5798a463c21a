"""Linear smoothers of long series, spread over many tasks: one operator of `pieces`, for DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemill.operators.series import Kernel, Series, check_period, smoother


def smooth_long(df: DataFrame, keys: list[str], ord: str, x: str, alpha: float, n: int, out: str, pieces: int = 64) -> DataFrame:
    """df with column `out`: exponential smoothing seeded with the mean of each key's first n rows; NaN before that, and from
    the first NaN on. An EMA has alpha = 2 / (n + 1), Wilder's average 1 / n."""
    check_period(n)

    def smoothed(s: Series):
        return (yield Kernel(smoother(alpha, n), [x], smooth=(alpha, n, 0)))

    return Series(df, keys, ord, pieces).compute(**{out: smoothed})
