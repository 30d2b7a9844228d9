import duckdb
import pytest

import __spark_entry__ as entry
from transitloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return 0.0 if isinstance(value, float) and value == 0 else value


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert not entry.oracle_sql().keys() - entry.queries().keys()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((str([plain(row[names.index(c)]) for c in sorted(names)]) for row in found.fetchall()))
    got = sorted((str([plain(row[c]) for c in sorted(names)]) for row in df.collect()))
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_query_without_sql_runs_alike(spark, name):
    """Twice the same rows; what they are is compared with brute force in the operators' tests."""
    first, again = ([str(r) for r in registry.QUERIES[name](spark, SF).collect()] for _ in range(2))
    assert first and sorted(first) == sorted(again)
