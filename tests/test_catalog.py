"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from skirmish import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def cells(rows):
    return sorted([tuple(None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v) for v in r) for r in rows], key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = cells(df.select(*names).collect())
    if name in catalog.ORACLE_SQL:
        r = con.execute(catalog.ORACLE_SQL[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == names
        assert got == cells([[row[cols.index(n)] for n in names] for row in r.fetchall()])
