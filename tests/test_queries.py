"""Every registered query gives rows, and with a SQL twin the same rows, at the smallest scale.

SCHOLARCH_SF picks another scale (sf0.001 by default).
"""

import os

import pytest
from compare import compare, connect

from scholarch.plans import ORACLES, QUERIES

FOLDER = f"/root/testdata/{os.environ.get('SCHOLARCH_SF', 'sf0.001')}"
# checked by brute force or against their batch form in test_rules.py
WITHOUT_SQL = {"align_modules", "best_fuzzy_code", "repair_module_names"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
