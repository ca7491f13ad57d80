"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from duskline.plans import catalog

SQL = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def base(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        try:
            return round(float(v), 6) + 0.0
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, base, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), base.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
