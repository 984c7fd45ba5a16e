"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(columns, found):
    shown = lambda v: "NULL" if v is None else repr(float(v)) if isinstance(v, (int, float)) else str(v)
    order = sorted(columns)
    return order, sorted(tuple(shown(r[columns.index(c)]) for c in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert found == rows(want.columns, want.fetchall())
    else:
        assert found[1]


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
