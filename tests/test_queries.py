"""Every registered query runs and agrees with its SQL where it has some."""

import duckdb
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr(plain(tuple(r[c] for c in cols))) for r in df.collect())
    found = duck.execute(registry.SQL[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == cols
    want = sorted(repr(plain(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in (r[own.index(c)] for c in cols)))) for r in found.fetchall())
    assert got == want


def test_entry_imports():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.SQL) <= set(e.oracle_sql())
