"""Every registered query gives the rows of its SQL."""

from __future__ import annotations

import os

import pytest

from chatweave.plans.queries import REGISTRY
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    assert q.sql is not None
    assert differences(spark, con, name, q.run, q.sql, SF_DIR) == []


def test_entry_point():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
