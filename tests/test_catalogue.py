"""Each query that has SQL gives DuckDB's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from siftline.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in ORACLE_SQL:
        assert rows
        return
    told = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == cols
    assert sorted(repr([plain(r[c]) for c in cols]) for r in rows) == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in told.fetchall())
