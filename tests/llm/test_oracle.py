"""Registered training-data queries against their DuckDB text."""

import pytest

from cashcurve.llm.queries import ORACLE, QUERIES
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, key):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), key, QUERIES[key], ORACLE[key], sf)["status"] == "exact"


def test_one_query_per_operator():
    assert sorted(k.split("_")[0] for k in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
