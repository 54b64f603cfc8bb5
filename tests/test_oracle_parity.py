"""Every registered query against its DuckDB oracle (the driver's gate) on the smallest scale."""

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import compare

from cashcurve.plans.catalog import ORACLE, QUERIES


def test_every_query_has_an_oracle_or_a_reason():
    from cashcurve.plans.registry import NO_ORACLE_REASON
    missing = [k for k in QUERIES if k not in ORACLE and k not in NO_ORACLE_REASON]
    assert missing == []


def test_entry_has_every_query_and_oracle():
    from __spark_entry__ import oracle_sql, queries
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "ytd_net_profit" in df.columns


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_small, key):
    info = compare(spark, duck_small, key, QUERIES[key], ORACLE[key], SF_SMALL)
    assert info["status"] == "exact", info
