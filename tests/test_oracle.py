"""Every registered query against its checking SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from tools.check import compare, engine  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return engine(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF).toArrow()
    if name in ORACLES:
        assert compare(got, duck.sql(ORACLES[name]).to_arrow_table()) == "ok"


def test_entry(spark):
    assert contract.entry(spark).count() > 0
