"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from comparing import compare, duck
from feedlake.plans.oracles import ORACLES
from feedlake.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, folder, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], folder) is None


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
