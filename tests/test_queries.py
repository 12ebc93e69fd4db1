"""Every query of the library against its DuckDB twin, and the entry points."""

import pytest

import __spark_entry__
from solfa.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(name, same_rows):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert {"action", "tag", "n"} == set(rows.columns) and rows.count() > 10
    assert len(set(rows.columns)) == len(rows.columns)
