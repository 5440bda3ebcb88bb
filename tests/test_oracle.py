"""Every registered query of the engine against DuckDB; those without SQL must run."""

import pytest

from gateloom.plans import registry
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, small, name):
    check(spark, small, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, small, name):
    """Rows there are, and no column is without a value or holds a NaN or an infinite number."""
    rows = registry.QUERIES[name](spark, small).limit(2_000).toPandas()
    assert len(rows)
    for c in rows.columns:
        assert rows[c].notna().any(), c
        if rows[c].dtype.kind == "f":
            assert not rows[c].abs().eq(float("inf")).any(), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
