"""Every query of the model gives the rows of its SQL oracle on the smallest tables."""

import duckdb
import pytest

from presswork import catalog
from presswork.plans.bridge import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(same(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(entry.queries())
