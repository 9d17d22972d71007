"""Tables of few times take few tasks; the rows of an expansion stay where they are."""

import random

import numpy as np
import pytest

import survlake as sv
from survlake.operators import cox


@pytest.fixture
def data(spark):
    r = random.Random(5)
    rows = [(i, r.randint(1, 30), r.choice([0, 1, 1, 2]), *[r.gauss(0, 1) for _ in range(3)]) for i in range(300)]
    return spark.createDataFrame(rows, "id int, t int, ev int, a double, b double, c double")


def with_conf(spark, key, value, run):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        return run()
    finally:
        spark.conf.set(key, old)


def test_few_times_take_few_tasks(spark, data):
    rows = data.selectExpr("0 AS _stratum", "t AS _stop", "int(ev = 1) AS _delta", "1D AS _w", "a AS x0")

    def tasks():
        fit = cox._Fit(rows, 1, "efron", False, None, "auto")
        return fit.hazard(np.zeros(1)).persist().rdd.getNumPartitions()
    assert with_conf(spark, "spark.sql.shuffle.partitions", "50", tasks) <= 8


def test_expansion_sends_the_times_not_the_rows(spark, data, capsys):
    with_conf(spark, "spark.sql.autoBroadcastJoinThreshold", "-1", lambda: sv.finegray_expand(data, 1, "ev", "t").explain())
    assert capsys.readouterr().out.count("BroadcastHashJoin") >= 2


def test_cross_products_in_generated_code_and_in_python_agree(spark, data, monkeypatch):
    def fit():
        m = sv.cox_fit(data, "t", data["ev"] == 1, ["a", "b", "c"], cluster="id")
        return np.concatenate([m.coef, m.naive_var.ravel(), m.robust_var.ravel()])
    here = fit()
    monkeypatch.setattr(cox, "FEW_TERMS", 0)
    assert np.allclose(here, fit(), rtol=1e-10, atol=1e-13)
