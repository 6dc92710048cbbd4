"""Each registered query of the knowledge model against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from weftgraph import catalogue, sql

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for table in Path(TABLES).glob("*.parquet"):
        con.execute(f"create view {table.stem} as select * from '{table}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, oracle, name):
    rows = catalogue.queries()[name](spark, TABLES)
    asked = oracle.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in asked.description]
    assert sorted(columns) == sorted(rows.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    assert found == sorted((tuple(map(plain, r)) for r in asked.fetchall()), key=repr)
    assert found


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 20
