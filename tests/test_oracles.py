"""Every registered query that has SQL, against DuckDB on the small tables."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op") and n != "pipeline"}


def _shown(v):
    return ("nan" if v != v else v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    relation = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    mine = sorted((tuple(_shown(r[c]) for c in columns) for r in df.collect()), key=str)
    other = sorted((tuple(map(_shown, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert mine == other


def test_entry(spark):
    assert entry.entry(spark).count() > 0
