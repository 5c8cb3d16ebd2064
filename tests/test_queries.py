"""Every registered query against its SQL twin."""

import os

import pytest

from cuentaclara.plans.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_names_are_plain():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith(("op", "pipeline"))]
