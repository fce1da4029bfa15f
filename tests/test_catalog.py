"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from hazeline.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    r = con.execute(catalog.oracle_sql()[name])
    order = [[d[0] for d in r.description].index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain(tuple(x[i] for i in order) for x in r.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
