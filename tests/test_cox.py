import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from survlake import cox_fit, finegray_expand, finegray_fit, kaplan_meier, nelson_aalen, survival_response
from survlake.operators import scan as scan_module


def _data(n=160, seed=3, horizon=30):
    """Subjects with one to three intervals, tied day times, two causes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x1, x2 = rng.integers(0, 2), round(rng.normal(), 3)
        final = int(rng.integers(2, horizon))
        cause = int(rng.choice([0, 1, 2], p=[0.35, 0.4, 0.25]))
        cuts = sorted(set(rng.integers(1, final, rng.integers(0, 3)).tolist())) if final > 1 else []
        marks = [0, *cuts, final]
        for a, b in zip(marks, marks[1:]):
            rows.append((i, a, b, final, cause if b == final else 0, int(x1), x2,
                         round(rng.normal(), 3), i % 3, round(float(rng.uniform(0.3, 2)), 2), cause))
    return pd.DataFrame(rows, columns=["id", "t0", "t1", "final", "ev", "x1", "x2", "x3", "g", "w", "last_cause"])


@pytest.fixture(scope="module")
def data():
    return _data()


@pytest.fixture(scope="module")
def sdf(spark, data):
    return spark.createDataFrame(data).withColumns({
        c: F.col(c).cast("int") for c in ("t0", "t1", "final", "ev", "x1", "g", "last_cause")}).cache()


X = ["x1", "x2", "x3"]


def _check(model, want, robust=True):
    np.testing.assert_allclose(model.coef, want["coef"], atol=1e-7)
    np.testing.assert_allclose(model.naive_var, want["var"], atol=1e-7)
    np.testing.assert_allclose(model.loglik[1], want["ll"], rtol=1e-9)
    if robust and "robust" in want:
        np.testing.assert_allclose(model.robust_var, want["robust"], atol=1e-7)
    assert model.converged


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_counting_process(sdf, data, ties):
    m = cox_fit(sdf, "t1", F.col("ev") == 1, X, start="t0", ties=ties, cluster="id")
    _check(m, brute.cox(data.t0, data.t1, data.ev == 1, data[X], ties=ties, cluster=data.id))


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_strata_weights_robust_by_row(sdf, data, ties):
    m = cox_fit(sdf, "t1", F.col("ev") > 0, X, start="t0", ties=ties, strata=["g"], weight="w")
    _check(m, brute.cox(data.t0, data.t1, data.ev > 0, data[X], data.w, data.g, ties, robust=True))


def test_right_censored_and_null_rows(spark, sdf, data):
    base = data[data.t0 == 0]
    holes = sdf.where("t0 = 0").withColumn("x2", F.when(F.col("id") % 5 != 0, F.col("x2")))
    m = cox_fit(holes, "final", F.col("last_cause") == 2, X)
    kept = base[base.id % 5 != 0]
    _check(m, brute.cox(kept.final * 0 - 1, kept.final, kept.last_cause == 2, kept[X]))
    assert m.n == len(kept)


def test_splitting_intervals_changes_nothing(sdf):
    whole = cox_fit(sdf.where("t0 = 0"), "final", F.col("last_cause") == 1, ["x1", "x2"], ties="efron")
    halves = sdf.where("t0 = 0").withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "a": F.when(F.col("_k") == 0, 0).otherwise(1), "b": F.when(F.col("_k") == 0, 1).otherwise(F.col("final"))})
    halves = halves.withColumn("e", F.when(F.col("b") == F.col("final"), F.col("last_cause")).otherwise(0))
    split = cox_fit(halves, "b", F.col("e") == 1, ["x1", "x2"], start="a", ties="efron")
    np.testing.assert_allclose(whole.coef, split.coef, atol=1e-8)
    np.testing.assert_allclose(whole.naive_var, split.naive_var, atol=1e-8)


def test_chunked_time_axis_and_shuffle_join_give_the_same_fit(sdf, monkeypatch):
    plain = cox_fit(sdf, "t1", F.col("ev") == 1, X, start="t0", cluster="id")
    monkeypatch.setattr(scan_module, "BROADCAST_BYTES", 0)
    chunked = cox_fit(sdf.repartition(7), "t1", F.col("ev") == 1, X, start="t0", cluster="id", splits=[5, 11, 20])
    np.testing.assert_allclose(plain.coef, chunked.coef, atol=1e-9)
    np.testing.assert_allclose(plain.robust_var, chunked.robust_var, atol=1e-9)


def test_four_subjects_two_tied_events_by_hand(spark):
    # risk set {1,1,0,0}, events: one with x=1, one with x=0, both at t=1
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 1), (2, 0, 0)], "t int, d int, x int")
    for ties in ("breslow", "efron"):
        m = cox_fit(df, "t", "d", ["x"], ties=ties)
        assert abs(m.coef[0]) < 1e-9                      # symmetric in x
        ll = -2 * np.log(4) if ties == "breslow" else -np.log(4) - np.log(3)
        assert abs(m.loglik[0] - ll) < 1e-9


def test_separation_is_flagged(spark):
    rows = [(t, int(t <= 5), int(t <= 5)) for t in range(1, 21)]
    df = spark.createDataFrame(rows, "t int, d int, x int")
    m = cox_fit(df, "t", "d", ["x"])
    assert not m.converged and m.coef[0] > 10
    assert [r.converged for r in m.summary().collect()] == [False]


def test_aliased_terms_are_null(sdf):
    d = sdf.withColumns({"one": F.lit(3.0), "both": F.col("x1") * 2 - F.col("x2") + 1})
    m = cox_fit(d, "t1", F.col("ev") == 1, ["one", "x1", "x2", "both"], start="t0", cluster="id")
    plain = cox_fit(d, "t1", F.col("ev") == 1, ["x1", "x2"], start="t0", cluster="id")
    got = {r.term: r for r in m.summary().collect()}
    for r in plain.summary().collect():
        for c in ("coef", "hr", "lower", "upper", "se", "robust_se", "z", "p"):
            assert abs(got[r.term][c] - r[c]) < 1e-8
    for t in ("one", "both"):
        assert all(got[t][c] is None for c in ("coef", "hr", "se", "robust_se", "z", "p")) and got[t].converged
    assert m.converged


def test_large_linear_predictors(sdf):
    """A term far from 0 shifts nothing and overflows nothing."""
    far = sdf.withColumn("x1", F.col("x1") * 1e6 + 1e9)
    a = cox_fit(sdf, "t1", F.col("ev") == 1, ["x1", "x2"], start="t0", baseline=True)
    b = cox_fit(far, "t1", F.col("ev") == 1, ["x1", "x2"], start="t0", baseline=True)
    np.testing.assert_allclose(a.coef, b.coef * [1e6, 1], rtol=1e-4)
    np.testing.assert_allclose(a.loglik, b.loglik, rtol=1e-9)
    ha, hb = (dict(m.baseline_hazard().collect()) for m in (a, b))
    np.testing.assert_allclose([ha[t] for t in sorted(ha)], [hb[t] for t in sorted(hb)], rtol=1e-5)


def test_summary_columns(sdf):
    s = cox_fit(sdf, "t1", F.col("ev") == 1, X, start="t0").summary()
    assert s.columns == ["term", "coef", "hr", "lower", "upper", "se", "robust_se", "z", "p", "converged"]
    r = s.where("term = 'x1'").first()
    assert r.lower < r.hr < r.upper and r.robust_se is None
    assert abs(r.hr - np.exp(r.coef)) < 1e-12


def test_null_model_baseline_is_nelson_aalen(sdf):
    m = cox_fit(sdf, "t1", F.col("ev") == 1, [], start="t0", ties="breslow", strata=["g"])
    got = {(r.g, r.time): r.hazard for r in m.baseline_hazard().collect()}
    resp = survival_response(sdf, "t1", "ev", 1, start="t0")
    want = {(r.g, r.time): r.hazard for r in nelson_aalen(resp, ["g"]).where("n_event > 0").collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert abs(got[k] - want[k]) < 1e-12
    efron = {(r.g, r.time): r.hazard for r in
             cox_fit(sdf, "t1", F.col("ev") == 1, [], start="t0", strata=["g"]).baseline_hazard().collect()}
    want = {(r.g, r.time): r.hazard for r in nelson_aalen(resp, ["g"], ties="efron").where("n_event > 0").collect()}
    for k in efron:
        assert abs(efron[k] - want[k]) < 1e-12


# --- Fine–Gray ---------------------------------------------------------------


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_finegray_fixed(sdf, data, ties):
    base = data[data.t0 == 0].reset_index(drop=True)
    m = finegray_fit(sdf.where("t0 = 0"), "final", "last_cause", 1, X, id="id", ties=ties, censoring_term=False)
    rows = brute.finegray_rows(base.final * 0, base.final, base.last_cause, 1)
    i = [r[0] for r in rows]
    want = brute.cox([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], base[X].to_numpy()[i],
                     [r[4] for r in rows], ties=ties, cluster=base.id.to_numpy()[i])
    _check(m, want)


def test_finegray_time_varying_and_expanded(sdf, data):
    m = finegray_fit(sdf, "t1", "ev", 2, X, start="t0", final="final", id="id", censoring_term=False)
    rows = brute.finegray_rows(data.t0, data.t1, data.ev, 2, last=data.t1 == data.final)
    i = [r[0] for r in rows]
    want = brute.cox([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], data[X].to_numpy()[i],
                     [r[4] for r in rows], cluster=data.id.to_numpy()[i])
    _check(m, want)
    table = finegray_expand(sdf, 2, "ev", "t1", start="t0", final="final")
    by_table = cox_fit(table, "fgstop", "fgstatus", X, start="fgstart", weight="fgwt", cluster="id")
    np.testing.assert_allclose(m.coef, by_table.coef, atol=1e-7)
    np.testing.assert_allclose(m.robust_var, by_table.robust_var, atol=1e-7)


def test_weighted_km_of_the_expansion_is_the_cif(sdf, data):
    base = data[data.t0 == 0]
    table = finegray_expand(sdf.where("t0 = 0"), 1, "last_cause", "final")
    resp = survival_response(table, "fgstop", "fgstatus", 1, start="fgstart")
    got = {r.time: 1 - r.surv for r in kaplan_meier(resp, weight="fgwt").where("n_event > 0").collect()}
    want = brute.cif(base.final, base.last_cause)
    assert got
    for t, v in got.items():
        assert abs(v - want[t][1]) < 1e-10


def _score(beta, start, stop, cause, focal, x, last, subject, weight):
    """Breslow score of the weighted subdistribution model; ``weight`` per subject also enters the censoring curve."""
    w = weight[subject]
    g, before = 1.0, {}
    for t in np.unique(stop):
        before[t] = g
        y = w[(start < t) & (stop >= t)].sum() - w[(stop == t) & (cause != 0)].sum()
        c = w[(stop == t) & (cause == 0) & last].sum()
        g *= 1 - c / y if c else 1
    ok = ~np.isnan(x).any(axis=1)
    r = np.where(ok, np.exp(np.where(ok[:, None], x, 0) @ beta), 0)
    x = np.where(ok[:, None], x, 0)
    rival = ~np.isin(cause, [0, focal])
    out = np.zeros(x.shape[1])
    for t in np.unique(stop[cause == focal]):
        at = ((start < t) & (stop >= t)).astype(float)
        late = rival & (stop < t)
        at[late] = [before[t] / before[s] for s in stop[late]]
        s0, s1 = (w * at * r).sum(), (w * at * r) @ x
        hit = (stop == t) & (cause == focal) & ok
        out += w[hit] @ (x[hit] - s1 / s0)
    return out


@pytest.mark.parametrize("form", ["fixed", "varying"])
def test_finegray_variance_with_the_censoring_curve(spark, data, form):
    """The influence of a subject is the derivative of the score by its weight, through the curve too."""
    d = (data[data.t0 == 0] if form == "fixed" else data).reset_index(drop=True).copy()
    stop, cause = (d.final, d.last_cause) if form == "fixed" else (d.t1, d.ev)
    start = d.t0 * 0 if form == "fixed" else d.t0
    last = (stop == d.final).to_numpy()
    x = d[X].to_numpy(dtype=float)
    x[3, 0] = np.nan      # in the curve, not in the fit
    frame = d.assign(**{X[0]: x[:, 0]})
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in frame.itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, list(frame.columns)).repartition(3)
    if form == "fixed":
        m = finegray_fit(df, "final", "last_cause", 1, X, id="id", ties="breslow")
        chunked = finegray_fit(df, "final", "last_cause", 1, X, id="id", ties="breslow", splits=[5, 9, 14])
    else:
        m = finegray_fit(df, "t1", "ev", 1, X, start="t0", final="final", id="id", ties="breslow")
        chunked = finegray_fit(df, "t1", "ev", 1, X, start="t0", final="final", id="id", ties="breslow", splits=[5, 9, 14])
    ids, subject = np.unique(d.id.to_numpy(), return_inverse=True)
    args = (start.to_numpy(), stop.to_numpy(), cause.to_numpy(), 1, x, last, subject)
    meat, h = np.zeros((len(X), len(X))), 1e-5
    for j in range(len(ids)):
        up, down = np.ones(len(ids)), np.ones(len(ids))
        up[j] += h
        down[j] -= h
        infl = (_score(m.coef, *args, up) - _score(m.coef, *args, down)) / (2 * h)
        meat += np.outer(infl, infl)
    want = m.naive_var @ meat @ m.naive_var
    np.testing.assert_allclose(m.robust_var, want, rtol=1e-5)
    np.testing.assert_allclose(chunked.robust_var, want, rtol=1e-5)
    known = finegray_fit(df, "final" if form == "fixed" else "t1", "last_cause" if form == "fixed" else "ev", 1, X, id="id", ties="breslow",
                         start=None if form == "fixed" else "t0", final=None if form == "fixed" else "final", censoring_term=False)
    assert not np.allclose(known.robust_var, want, rtol=1e-3)
