"""Every query of the engine's own catalog runs, and those with SQL agree with DuckDB, at the smallest scale."""

import duckdb
import numpy as np
import pytest

from lumenfold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return "null" if np.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.queries())))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if sql := catalog.oracle_sql().get(name):
        cur = duck.execute(sql)
        cols = [c[0] for c in cur.description]
        want = sorted(tuple(shown(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
        assert sorted(df.columns) == sorted(cols)
        assert sorted(tuple(shown(r[c]) for c in sorted(cols)) for r in rows) == want


def test_entry_without_its_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
