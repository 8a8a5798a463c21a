"""Smoothing by pieces equals smoothing row by row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import series as ops
from tidemill.operators.scan import smooth_long
from tidemill.operators.series import Series


@pytest.mark.parametrize("pieces", [1, 7, 64])
def test_pieces_equal_rows(spark, pieces):
    rng = random.Random(1)
    rows = [(k, i * i, rng.gauss(0, 1) if (k, i) != (2, 30) else math.nan) for k in (0, 1, 2, None) for i in range({0: 120, 1: 3, 2: 50}.get(k, 40))]
    df = spark.createDataFrame(rows, "k int, i long, x double").repartition(3)
    got = {(r.k, r.i): r.e for r in smooth_long(df, ["k"], "i", "x", 0.4, 4, "e", pieces).collect()}
    want = {(r.k, r.i): r.e for r in Series(df, ["k"], "i").compute(e=lambda s: (yield ops.Kernel(ops.smoother(0.4, 4), ["x"]))).collect()}
    assert len(got) == len(rows) == len(want)
    for key, v in want.items():
        assert (v != v and got[key] != got[key]) or got[key] == pytest.approx(v, rel=1e-11), key


def test_timestamps_and_one_series(spark):
    df = spark.range(50).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    got = [r.e for r in smooth_long(df, [], "t", "x", 0.5, 3, "e", 8).orderBy("t").collect()]
    y, want = None, []
    for i in range(50):
        y = None if i < 2 else 1.0 if i == 2 else 0.5 * (i % 7) + 0.5 * y
        want.append(y)
    assert all((a is None and b != b) or a == pytest.approx(b) for a, b in zip(want, got, strict=True))
    assert smooth_long(df.limit(0), [], "t", "x", 0.5, 3, "e").count() == 0
