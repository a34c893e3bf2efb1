"""Every query that has SQL gives the same rows as that SQL on the smallest tables; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from sorkuvai.plans.oracle import ORACLE
from sorkuvai.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return f"{float(x):.9g}" if type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in ORACLE:
        found = sql.execute(ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    else:
        assert rows


def test_sql_names_queries():
    assert set(ORACLE) <= set(QUERIES)
