"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


#: The training-data operators have tests of their own.
NAMES = list(entry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    _, problems = compare(entry.queries()[name](spark, SF_DIR), SF_DIR, entry.oracle_sql().get(name))
    assert not problems


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql())
