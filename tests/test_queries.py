"""Each registered query of the library against its DuckDB statement."""

import math
from pathlib import Path

import duckdb
import pytest

from asofkit import plans

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canonical(rows, columns):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_integer_ratio"):
            return str(v)
        return f"{float(v) + 0.0:.5g}"
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows is not None and df.columns
        return
    want = duck.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(rows, df.columns) == canonical(want.fetchall(), columns)
