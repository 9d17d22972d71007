import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
import survlake as sv
from survlake.operators.scan import tie_sums
from survlake.plans.fixtures import STATES


@pytest.fixture(scope="module")
def base():
    rng = np.random.default_rng(5)
    n = 200
    return pd.DataFrame({"id": range(n), "time": rng.integers(1, 25, n), "cause": rng.choice([0, 1, 2], n),
                         "g": rng.integers(0, 2, n)})


@pytest.fixture(scope="module")
def sdf(spark, base):
    return spark.createDataFrame(base).withColumns({c: F.col(c).cast("int") for c in base}).cache()


def curve(df, value, *keys):
    return {tuple(r[k] for k in (*keys, "time")): r[value] for r in df.collect()}


def test_kaplan_meier_with_ties_and_last_subject_failing(spark):
    # day 2: one event and one censoring; the last subject fails, so the curve ends at 0
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (4, 1), (4, 1)], "t int, c int")
    got = {r.time: (r.n_risk, r.surv) for r in sv.kaplan_meier(sv.survival_response(df, "t", "c", 1)).collect()}
    assert got[1] == (6, pytest.approx(5 / 6))
    assert got[2] == (5, pytest.approx(5 / 6 * 4 / 5))
    assert got[3] == (3, pytest.approx(2 / 3))
    assert got[4] == (2, 0.0)


def test_censoring_curve_leaves_out_events_of_the_same_time(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (4, 1)], "t int, c int")
    g = {r.time: (r.g_before, r.g) for r in sv.censoring_weights(df, "t", "c").collect()}
    assert g[2] == (1.0, pytest.approx(1 - 1 / 3)) and g[4] == (pytest.approx(2 / 3 / 2),) * 2


@pytest.mark.parametrize("splits", ["auto", [4, 9, 9, 17]])
def test_curves_against_brute_force(sdf, base, splits):
    km = curve(sv.kaplan_meier(sv.survival_response(sdf, "time", "cause", 1), splits=splits), "surv")
    want = brute.km(base.time * 0, base.time, base.cause == 1)
    assert {k[0] for k in km} == set(want)
    for t, v in want.items():
        assert km[(t,)] == pytest.approx(v, abs=1e-12)
    cif = curve(sv.cumulative_incidence(sdf, "time", "cause", splits=splits), "est", "cause")
    for t, v in brute.cif(base.time, base.cause).items():
        assert cif[(1, t)] == pytest.approx(v[1], abs=1e-12) and cif[(2, t)] == pytest.approx(v[2], abs=1e-12)


def test_identities(sdf):
    both = sv.survival_response(sdf, "time", "cause")
    surv = curve(sv.kaplan_meier(both), "surv")
    cif = curve(sv.cumulative_incidence(sdf, "time", "cause"), "est", "cause")
    cmp = sv.compare_km_cif(sdf, "time", "cause", {1: "a", 2: "b"}, "any")
    series = {(r.which_est, r.which_event, r.time): r.est for r in cmp.collect()}
    for (t,), s in surv.items():
        assert s + cif[(1, t)] + cif[(2, t)] == pytest.approx(1, abs=1e-12)
        assert series[("1 - KM", "any", t)] == pytest.approx(series[("CIF", "any", t)], abs=1e-12)
        assert series[("CIF", "a", t)] <= series[("1 - KM", "a", t)] + 1e-12


def test_risk_table_does_not_depend_on_splitting_or_order(sdf):
    whole = sorted(map(tuple, sv.risk_table(sv.survival_response(sdf, "time", "cause")).collect()))
    pieces = sdf.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("time") - 1))).withColumn("b", F.col("a") + 1)
    pieces = pieces.withColumn("e", F.when(F.col("b") == F.col("time"), F.col("cause")).otherwise(0)).repartition(13)
    resp = sv.survival_response(pieces, "b", "e", start="a")
    cut = sv.risk_table(resp, last=F.col("b") == F.col("time"))
    cut = cut.where("n_event > 0 or n_censor > 0")
    assert sorted(map(tuple, cut.collect())) == whole


def test_endpoints(spark, sdf, base):
    r = sv.survival_response(sdf, "time", "cause", 2)
    assert r.agg(F.sum("surv_status")).first()[0] == int((base.cause == 2).sum())
    assert sv.combined_endpoint(sdf, "cause", [1, 2], "x").agg(F.sum("x")).first()[0] == int((base.cause > 0).sum())
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "e string")
    assert [x.event_code for x in sv.relevel_event(df, "e", "a", ["c", "a", "b"]).collect()] == [2, 0, 1, None]


def test_tie_sums_equal_the_plain_sums(spark):
    cases = [(0, 9.0, 0.0), (5, 9.0, 4.0), (512, 512.0, 512.0), (513, 600.0, 513.0), (10_000, 12_000.0, 11_999.0),
             (10_000, 1e12, 3e3), (1_000_000, 1e6, 1e6), (1_000_000, 1e6 + 0.5, 1e6), (1_000_000, 2.5e9, 7e5),
             (700_000, 3.0, 1e-3), (5000, 10.0, 0.0)]
    df = spark.createDataFrame([(i, float(m), s, e) for i, (m, s, e) in enumerate(cases)], "time int, m double, s double, e double")
    got = {r.time: r for r in tie_sums(df, "m", "s", "e").collect()}
    for t, (m, s, e) in enumerate(cases):
        c = np.arange(m) / max(m, 1)
        q = s - c * e
        want = {"b0": 1 / q, "b1": c / q, "a0": 1 / q ** 2, "a1": c / q ** 2, "a2": c * c / q ** 2, "lq": np.log(q)}
        assert {k: got[t][k] for k in want} == {k: pytest.approx(math.fsum(v), rel=1e-10) for k, v in want.items()}, cases[t]


# --- landmarks -------------------------------------------------------------------------


def _intervals(spark):
    return spark.createDataFrame([
        (1, 0, 5, 12, 1, 0), (1, 5, 12, 12, 1, 1), (2, 0, 10, 10, 2, 2), (3, 0, 30, 200, 1, 0), (3, 30, 200, 200, 1, 1)],
        "id int, start_time int, end_time int, time int, status int, event_numeric int")


def test_landmark_equal_to_a_visit_and_to_the_final_time(spark):
    cp = _intervals(spark)
    keys = ("LM", "id", "start_time", "time", "status")
    left = sorted(tuple(r[k] for k in keys) for r in sv.landmark_cut(cp, [5, 10], 100, "status").collect())
    assert left == [(5, 1, 0, 12, 1), (5, 2, 0, 10, 2), (5, 3, 0, 105, 0), (10, 1, 5, 12, 1), (10, 3, 0, 110, 0)]
    right = sorted(tuple(r[k] for k in keys) for r in sv.landmark_cut(cp, [5, 10], 100, "status", closed="right").collect())
    assert right == [(5, 1, 5, 12, 1), (5, 2, 0, 10, 2), (5, 3, 0, 105, 0), (10, 1, 5, 12, 1), (10, 3, 0, 110, 0)]
    own = sv.landmark_cut(cp, [5], 100, "event_numeric").where("id = 1").first()
    assert own.event_numeric == 0 and own.LM2 == 25
    assert sv.landmark_grid(5, 100, 5) == list(range(5, 101, 5))


def test_supermodels_against_brute_force(spark):
    from survlake.plans import fixtures as fx
    cp = fx.cp(spark, "/root/testdata/sf0.001")
    stack = sv.landmark_cut(cp, [1200, 1500, 1800], 700, "status").cache()
    pdf = stack.select("LM", "Tstart", "time", "status", "response", "sex", "LM1", "LM2", "id").toPandas().dropna()
    x = ["response", "sex"]
    m = sv.landmark_supermodel(stack, x, F.col("status") == 1, "id")
    want = brute.cox(pdf.Tstart, pdf.time, pdf.status == 1, pdf[x], strata=pdf.LM, ties="breslow", cluster=pdf.id)
    np.testing.assert_allclose(m.coef, want["coef"], atol=1e-7)
    np.testing.assert_allclose(m.robust_var, want["robust"], atol=1e-7)
    m = sv.landmark_supermodel(stack, x, F.col("status") == 1, "id", form="poly")
    z = pdf[[*x, "LM1", "LM2"]] / [1, 1, 1e3, 1e6]
    want = brute.cox(pdf.Tstart, pdf.time, pdf.status == 1, z, ties="breslow", cluster=pdf.id)
    np.testing.assert_allclose(m.coef * [1, 1, 1e3, 1e6], want["coef"], atol=1e-5)


# --- multi-state -----------------------------------------------------------------------


def _path(spark):
    # there and back, then the end; one unknown state
    df = spark.createDataFrame([
        (1, 0, 2, 2.0, 0), (1, 2, 5, 1.0, 0), (1, 5, 7, 3.0, 0), (1, 7, 9, 1.0, 1),
        (2, 0, 4, 1.0, 0), (2, 4, 6, None, 2), (3, 0, 6, 2.0, 0)],
        "id int, start_time int, end_time int, m double, event int")
    state = F.when(F.col("m") >= 1.5, "Non-responding").when(F.col("m") < 1.5, "Responding")
    end = F.when(F.col("event") == 1, "Dead").when(F.col("event") == 2, "Transplant")
    return sv.assign_states(df, state, "id", ["start_time"], end)


def test_states_and_transition_rows(spark):
    states = _path(spark)
    got = sorted((r.id, r.start_time, str(r["from"]), r.to_event) for r in states.collect())
    assert got == [(1, 0, "Non-responding", "Responding"), (1, 2, "Responding", "Non-responding"),
                   (1, 5, "Non-responding", "Responding"), (1, 7, "Responding", "Dead"),
                   (2, 0, "Responding", "Responding"), (2, 4, "None", "Transplant"),
                   (3, 0, "Non-responding", "Non-responding")]
    rows = sv.expand_transitions(states, sv.transition_matrix(spark, STATES))
    assert rows.count() == 6 * 3
    assert rows.where("`from` = `to`").count() == 0
    assert sorted((r.id, r.start_time, r.trans) for r in rows.where("status = 1").collect()) == [
        (1, 0, 1), (1, 2, 4), (1, 5, 1), (1, 7, 6)]


@pytest.mark.parametrize("splits, from_time", [("auto", 0), ([4, 6], 0), ([1, 100, 200, 900], 0), (list(range(20, 900, 30)), 150)])
def test_probabilities(spark, splits, from_time):
    from survlake.plans import fixtures as fx
    cp = fx.cp(spark, "/root/testdata/sf0.001")
    state = F.when(F.col("marker") >= 1.5, "Non-responding").when(F.col("marker") < 1.5, "Responding")
    end = F.when(F.col("event_numeric") == 1, "Dead").when(F.col("event_numeric") == 2, "Transplant")
    rows = sv.expand_transitions(sv.assign_states(cp, state, "id", ["start_time"], end),
                                 sv.transition_matrix(spark, STATES))
    hz = sv.transition_hazards(rows).cache()
    probs = sv.transition_probabilities(hz, STATES, from_time, splits).toPandas()
    sums = probs.groupby(["time", "from"]).prob.sum()
    np.testing.assert_allclose(sums, 1, atol=1e-12)
    h = hz.where(f"n_event > 0 AND time > {from_time}").toPandas()
    names, p = list(STATES), np.eye(4)
    want = {}
    for t in sorted(h.time.unique()):
        step = np.zeros((4, 4))
        for r in h[h.time == t].itertuples():
            step[names.index(r[2]), names.index(r.to)] = r.n_event / r.n_risk
        step[range(4), range(4)] = 1 - step.sum(axis=1)
        p = p @ step
        want[t] = p.copy()
    assert set(probs.time) == set(want)
    for r in probs.itertuples():
        assert r.prob == pytest.approx(want[r.time][names.index(r[2]), names.index(r.to)], abs=1e-10)


def test_probability_labels(spark):
    probs = spark.createDataFrame([(1, "Responding", "Dead", .2), (1, "Dead", "Dead", 1.)], "time int, `from` string, `to` string, prob double")
    got = sv.probabilities_long(probs, ["Dead"], ["Responding"], {"Dead": "Death"}).collect()
    assert [(r["from"], r.outcome, r.prob) for r in got] == [("Responding", "Death", .2)]


# --- reports ----------------------------------------------------------------------------


def test_reports(sdf):
    df = sdf.withColumns({"x": F.col("id") % 2, "y": F.col("id") % 5})
    a = sv.cox_fit(df, "time", F.col("cause") == 1, ["x", "y"])
    b = sv.cox_fit(df, "time", F.col("cause") == 1, ["x"])
    wide = {r.term: r for r in sv.endpoint_table({"one": a, "two": b}).collect()}
    assert wide["y"].two_hr is None and wide["x"].one_lower < wide["x"].one_hr < wide["x"].one_upper
    table = {r.term: r for r in sv.all_models_table({"one": a, "two": b}, labels={"x": "X (1/0)"}).collect()}
    assert table["y"].two == "" and table["x"].label == "X (1/0)" and table["y"].label == "y"
    marked = sv.significance_mark(a.summary(), alpha=1.1).collect()
    assert all(r.significant == 1 and r.text.endswith("*") for r in marked)
    r = sv.significance_mark(a.summary(), alpha=0.0).first()
    assert r.significant == 0 and float(r.text) == pytest.approx(r.hr, abs=0.0051)


def test_transition_models(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(i % 2 + 1), 0, int(rng.integers(1, 9)), int(rng.integers(0, 2)), int(rng.integers(0, 2)))
                                for i in range(120)], "id int, trans int, start_time int, end_time int, status int, x int")
    models = sv.transition_cox(df, ["x"], [1, 2])
    one = df.where("trans = 2").toPandas()
    want = brute.cox(one.start_time, one.end_time, one.status, one[["x"]], ties="breslow")
    np.testing.assert_allclose(models[2].coef, want["coef"], atol=1e-7)
