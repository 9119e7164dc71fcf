"""The library's queries against their SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from chronolith.queries import FLAGSHIP, ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    found = db.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([row[names.index(c)] for c in columns]) for row in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert FLAGSHIP in e.queries() and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
