"""Every registered query against its SQL twin, or at least to completion."""

import os

import oracle
import pytest

from tidegate.plans import load

FOLDER = os.environ.get("TIDEGATE_TEST_DATA", "/root/testdata/sf0.001")
REG = load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_matches_sql(spark, con, planned, name):
    assert oracle.compare(spark, con, lambda t: planned(name, FOLDER), REG.sql[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(REG.plans) - set(REG.sql)))
def test_runs(planned, name):
    assert planned(name, FOLDER).count() > 0
