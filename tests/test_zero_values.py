"""Values of 0: queries on them against their SQL, and what masks make of 0 / 0."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemill.functions import scalar as sc


def test_masks_of_zeros_equal_sql(spark, tmp_path):
    import duckdb

    at = tmp_path / "events.parquet"
    # Zeros at multiples of 11, of 97, of both and of neither.
    spark.range(2200).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") % 3).cast("double").alias("value")).write.parquet(str(at))
    df = entry.queries()["vec_masks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{at}/*.parquet'")
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"select {columns} from ({entry.oracle_sql()['vec_masks']}) order by event_id").fetchall()
    assert [tuple(r) for r in df.orderBy("event_id").collect()] == want


def test_zero_over_zero_is_no_infinity(spark):
    none = sc.div(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(sc.is_nan(none).alias("nan"), sc.is_inf(none).alias("inf"), sc.is_finite(none).alias("finite")).first()
    assert row.nan and not row.inf and not row.finite
