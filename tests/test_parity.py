"""Every registered query with SQL gives what that SQL gives, on the smallest tables."""

import pytest
from parity import compare, duck

from conceptframe.plans import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, _ = compare(spark, con, FOLDER, QUERIES[name], SQL.get(name))
    assert verdict.startswith("ok")
