"""Whole-series reductions, as aggregate columns for groupBy(keys).agg(...). Partial sums go before the shuffle.

NaN wins everywhere (Spark's min and percentile would skip or misplace it); a reduction over nothing gives what each
docstring says, which Spark shows for an empty table only without keys. Those that need a mean first (moments, mean absolute
deviation, MAD) take a DataFrame: two passes over one key, the second after a join of small rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import ieee
from tidemill.functions.ieee import INF, NAN, col, or_nan


def _any_nan(*xs: Column) -> Column:
    flag = F.isnan(xs[0])
    for x in xs[1:]:
        flag = flag | F.isnan(x)
    return F.coalesce(F.bool_or(flag), F.lit(False))


def sum_(x) -> Column:
    """Nothing: 0."""
    return F.coalesce(F.sum(col(x)), F.lit(0.0))


def mean(x) -> Column:
    """Nothing: 0."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


def dot(x, y) -> Column:
    return sum_(col(x) * col(y))


def sum_sq(x) -> Column:
    return sum_(col(x) * col(x))


def min_(x) -> Column:
    """Nothing: +Inf."""
    return F.when(_any_nan(col(x)), NAN).otherwise(F.coalesce(F.min(col(x)), F.lit(INF)))


def max_(x) -> Column:
    """Nothing: -Inf."""
    return F.coalesce(F.max(col(x)), F.lit(-INF))


def min_max(x) -> Column:
    return F.struct(min_(x).alias("lo"), max_(x).alias("hi"))


def count_greater_scalar(x, k: float) -> Column:
    return F.count_if(ieee.gt(x, k))


def count_greater_equal_scalar(x, k: float) -> Column:
    return F.count_if(ieee.ge(x, k))


def variance(x) -> Column:
    return or_nan(F.var_pop(col(x)))


def variance_sample(x) -> Column:
    return or_nan(F.var_samp(col(x)))


def std_dev(x) -> Column:
    return or_nan(F.stddev_pop(col(x)))


def std_dev_sample(x) -> Column:
    return or_nan(F.stddev_samp(col(x)))


def covariance(x, y) -> Column:
    return or_nan(F.covar_pop(col(x), col(y)))


def covariance_sample(x, y) -> Column:
    return or_nan(F.covar_samp(col(x), col(y)))


def correlation(x, y) -> Column:
    """NaN without spread."""
    spread = F.stddev_pop(col(x)) * F.stddev_pop(col(y))
    return or_nan(F.covar_pop(col(x), col(y)) / F.when(spread != 0, spread))


def skewness(x) -> Column:
    return or_nan(F.when(F.var_pop(col(x)) != 0, F.skewness(col(x))))


def kurtosis(x) -> Column:
    """Excess."""
    return or_nan(F.when(F.var_pop(col(x)) != 0, F.kurtosis(col(x))))


def rms(x) -> Column:
    return or_nan(F.sqrt(F.avg(col(x) * col(x))))


def geo_mean(x) -> Column:
    return or_nan(F.exp(F.avg(ieee.ln(x))))


def harm_mean(x) -> Column:
    return or_nan(ieee.div(F.count(col(x)).cast("double"), F.sum(ieee.div(1.0, x))))


def downside_deviation(x, target: float) -> Column:
    """Fewer than two values, a NaN target or a NaN value: NaN."""
    if target != target:
        return F.lit(NAN) + F.count(col(x)) * 0
    below = F.when(ieee.lt(x, target), F.pow(col(x) - target, F.lit(2.0))).otherwise(0.0)
    n = F.count(col(x))
    return F.when(_any_nan(col(x)) | (n < 2), NAN).otherwise(F.sqrt(F.sum(below) / F.when(n > 1, n - 1)))


def beta(x, y) -> Column:
    """Slope of x on y; NaN without spread in y."""
    v = F.var_pop(col(y))
    return or_nan(F.covar_pop(col(x), col(y)) / F.when(v != 0, v))


def quantile(x, q: float) -> Column:
    """Linear interpolation between order statistics; exact."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    return F.when(_any_nan(col(x)), NAN).otherwise(or_nan(F.percentile(col(x), F.lit(q))))


def median(x) -> Column:
    return quantile(x, 0.5)


def percentile(x, p: float) -> Column:
    return quantile(x, p / 100)


def arg_min(x, i) -> Column:
    """The index column's value at the first minimum; -1 for nothing or NaN."""
    return F.when(_any_nan(col(x)), -1).otherwise(F.coalesce(F.min_by(col(i), F.struct(col(x), col(i))), F.lit(-1))).cast("long")


def arg_max(x, i) -> Column:
    return F.when(_any_nan(col(x)), -1).otherwise(F.coalesce(F.min_by(col(i), F.struct(-col(x), col(i))), F.lit(-1))).cast("long")


def arg_min_max(x, i) -> Column:
    return F.struct(arg_min(x, i).alias("lo"), arg_max(x, i).alias("hi"))


def has_nan(x) -> Column:
    return _any_nan(col(x))


def first_valid(x, i) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(col(x)), col(i))), F.lit(-1)).cast("long")


def count_true(m) -> Column:
    return F.count_if(col(m))


def any_true(m) -> Column:
    return F.coalesce(F.bool_or(col(m)), F.lit(False))


def all_true(m) -> Column:
    return F.coalesce(F.bool_and(col(m)), F.lit(True))


def masked_sum(x, m) -> Column:
    return sum_(F.when(col(m), col(x)))


def masked_mean(x, m) -> Column:
    return mean(F.when(col(m), col(x)))


def masked_min(x, m) -> Column:
    return min_(F.when(col(m), col(x)))


def masked_max(x, m) -> Column:
    return max_(F.when(col(m), col(x)))


def _centred(df: DataFrame, keys: list[str], x: str, centre: Column) -> DataFrame:
    """df's x with each key's centre beside it as `c`: a join with one row a key, which Catalyst broadcasts if it is small."""
    centres = df.groupBy(*keys).agg(centre.alias("c"), F.count("*").alias("n"))
    own = df.select(*keys, col(x).alias("x"))
    return own.join(centres, keys) if keys else own.join(F.broadcast(centres))


def moment(df: DataFrame, keys: list[str], x: str, k: int) -> DataFrame:
    """keys, moment: the k-th central moment. k = 0: 1, k = 1: 0, also with NaN; k < 0: NaN."""
    if k < 2:
        return df.groupBy(*keys).agg(F.lit({0: 1.0, 1: 0.0}.get(k, NAN)).alias("moment"))
    return _centred(df, keys, x, F.avg(col(x))).groupBy(*keys).agg(or_nan(F.avg(F.pow(F.col("x") - F.col("c"), F.lit(float(k))))).alias("moment"))


def mean_abs_deviation(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return _centred(df, keys, x, F.avg(col(x))).groupBy(*keys).agg(or_nan(F.avg(F.abs(F.col("x") - F.col("c")))).alias("mean_abs_deviation"))


def mad(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, mad: the median of the distances from the median, without a consistency factor."""
    near = _centred(df, keys, x, median(x)).select(*keys, F.when(F.abs(F.col("c")) == INF, NAN).otherwise(F.abs(F.col("x") - F.col("c"))).alias("d"))
    return near.groupBy(*keys).agg(median("d").alias("mad"))


def max_drawdown(df: DataFrame, keys: list[str], x: str, i: str, parts: int = 64) -> DataFrame:
    """keys, max_drawdown, peak, trough, recovery: indices from column i (0-based), -1 for none.

    Each key's rows are summed up in `parts` ranges of i: the highest and the lowest value and the worst fall within. Against
    the highest value of the ranges before, a range's worst fall is that to its lowest value; one that a higher value of
    the same range precedes is smaller than the fall from that. So no task holds more than a range of a key."""
    from tidemill.operators.pieces import beside, cuts_of, part_of

    rows = df.select(*keys, col(i).alias("i"), col(x).alias("x"))
    number = F.col("i").cast("double")
    rows = rows.withColumn("_part", part_of(number, cuts_of(rows, number, parts)))
    w = Window.partitionBy(*keys, "_part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    high = F.max(F.when(F.col("x") > 0, F.col("x"))).over(w)

    def worse(peak: Column, x: Column, i: Column) -> Column:
        """Sorts the worst fall first, then the earliest, then the one from the highest peak."""
        return F.when(peak > 0, F.struct((-(peak - x) / F.when(peak > 0, peak)).alias("fall"), i.alias("i"), (-peak).alias("peak")))

    few = rows.withColumn("peak", high).withColumn("at", worse(F.col("peak"), F.col("x"), F.col("i"))).groupBy(*keys, "_part").agg(
        _any_nan(F.col("x")).alias("nan"), F.max("peak").alias("top"), F.min(F.struct("x", "i")).alias("low"), F.min("at").alias("own")
    )
    before = F.max("top").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("at", F.least("own", worse(before, F.col("low.x"), F.col("low.i"))))
    worst = few.groupBy(*keys).agg(F.bool_or("nan").alias("nan"), F.max("top").alias("any"), F.min("at").alias("at"))
    worst = worst.withColumn("dd", F.coalesce(-F.col("at.fall"), F.lit(0.0))).withColumn("at", F.when(F.col("dd") > 0, F.col("at")))
    top = -F.col("at.peak")
    found = beside(rows, worst, keys, not keys).groupBy(*keys).agg(
        F.first("nan").alias("nan"), F.first("any").alias("any"), F.first("dd").alias("dd"), F.first("at").alias("at"),
        F.min(F.when((F.col("x") == top) & (F.col("i") < F.col("at.i")), F.col("i"))).alias("peak"),
        F.min(F.when((F.col("x") >= top) & (F.col("i") > F.col("at.i")), F.col("i"))).alias("recovery"),
    )
    bad = F.coalesce(F.col("nan"), F.lit(False)) | F.col("any").isNull()

    def index(c: Column) -> Column:
        return F.when(bad, -1).otherwise(F.coalesce(c, F.lit(-1))).cast("long")

    return found.select(*keys, F.when(bad, NAN).otherwise(F.col("dd") + 0.0).alias("max_drawdown"), index(F.col("peak")).alias("peak"), index(F.col("at.i")).alias("trough"), index(F.col("recovery")).alias("recovery"))
