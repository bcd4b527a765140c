"""Every registered query runs, and equals its SQL where it has one."""

import os

import parity
import pytest

from factspark.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert parity.compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0
