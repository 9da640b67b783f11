"""Every registered query against its oracle SQL on the smallest given tables."""

import os

import pytest
from oracle import compare, connect

from framelane.bindings import ORACLES, QUERIES

SF_DIR = os.environ.get("FRAMELANE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    outcome = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert outcome.startswith(("ok", "rows-only")) and "types" not in outcome, outcome


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
