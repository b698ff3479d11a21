from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from oracle import connection, difference

ROOT = "/root/testdata/sf0.001"
OWN = [q for q in entry.queries() if not re.match(r"op\d|pipeline$", q)]
SQL = {k: v for k, v in entry.oracle_sql().items() if k in OWN}

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connection(ROOT)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(spark, ROOT, con, entry.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_runs_and_repeats(spark, name):
    first = sorted(map(repr, entry.queries()[name](spark, ROOT).collect()))
    assert first == sorted(map(repr, entry.queries()[name](spark, ROOT).collect()))


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
