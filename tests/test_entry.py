"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from vectrail.plans import registry

DATA = Path("/root/testdata/sf0.001")


def normal(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return None if v != v else round(float(v), 5)
    return [normal(x) for x in v]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((repr([normal(v) for v in r]) for r in frame.itertuples(index=False)))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    got, want = registry.queries()[name](spark, str(DATA)).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b


def test_entry_needs_no_llm(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
