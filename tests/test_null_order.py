"""Rows with a null order value: the same result below and above the limit for hot keys."""

import pytest
from pyspark.sql import functions as F

from survlake.operators import cox, risk, scan

ROWS = [("u", None, "n1", 1.0), ("u", 1, "a", None), ("u", 2, "b", None), ("u", 3, "c", 4.0), ("v", None, "n2", None), ("v", 9, "d", 2.0)]


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_neighbours_and_carry(spark, monkeypatch, limit):
    monkeypatch.setattr(scan, "ROWS_PER_KEY", limit)
    df = spark.createDataFrame(ROWS, "id string, t int, name string, v double")
    chunk = F.floor(F.col("t") / 2).cast("int")
    got = scan.adjacent_values(df, "id", ["t"], before={"p": "name"}, after={"q": "name"}, chunk=chunk)
    assert {r["name"]: (r["p"], r["q"]) for r in got.collect()} == {
        "n1": (None, "a"), "a": ("n1", "b"), "b": ("a", "c"), "c": ("b", None), "n2": (None, "d"), "d": ("n2", None)}
    got = scan.carry_forward(df, "id", ["t"], ["v"], chunk=chunk)
    assert {r["name"]: r["v"] for r in got.collect()} == {"n1": 1.0, "a": 1.0, "b": 1.0, "c": 4.0, "n2": None, "d": 2.0}


def test_any_axis_is_measured(spark):
    df = spark.range(120_000).select(F.col("id").cast("int").alias("t"))
    assert len(risk.resolve_splits(df, "t", "auto")) >= 2
    assert risk.resolve_splits(df.limit(100), "t", "auto") == []


def test_limits_of_a_separated_term_do_not_overflow():
    assert cox._exp(5000.0) == float("inf") and cox._exp(0.0) == 1.0
