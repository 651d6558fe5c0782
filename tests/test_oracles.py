"""Every registered query of the image operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from rasterflow import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_same_rows(spark, con, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    rel = con.sql(own.SQL[name])
    assert sorted(rel.columns) == cols
    exp = rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(exp, key=key)


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
