"""The driver's contract: names, SQL for known names only, and a flagship query that runs."""

import os

import pytest

import __spark_entry__ as entry


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 55


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 3
