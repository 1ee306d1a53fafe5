"""Every registered query against its DuckDB SQL on the sf0.001 tables (the
driver repeats this at sf0.01)."""

import os

import pytest

from tests.oracle_harness import compare, duck
from tillroll.registry import ORACLE, QUERIES

SF_DIR = os.environ.get("TILLROLL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, SF_DIR).count() >= 0
        return
    _, problems = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems, problems


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
