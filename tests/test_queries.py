"""Every registered query runs at the smallest scale and equals its SQL where it has one."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
entry = importlib.import_module("__spark_entry__")
check = importlib.import_module("check_queries")

# long reports: their parts are covered by other queries and by brute-force tests
SLOW = {"all_models_table", "transition_cox", "endpoint_table", "endpoint_table_finegray"}


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time", "cause", "est"] and df.count() > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, sf_dir, name):
    state, n, _, _, note = check.compare(spark, sf_dir, name)
    assert state in ("ok", "rows only"), note
    assert n > 0
