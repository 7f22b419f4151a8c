"""Every registered query against its SQL check on the smallest tables."""

import pytest

from checks import compare
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, SF, QUERIES[name])
    assert ok, note
