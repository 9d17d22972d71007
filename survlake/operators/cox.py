"""Cox regression by Newton–Raphson, one Spark job per step.

Let ``r = exp(x·b)``. A step needs, per event time, the weighted risk-set sums
``S0 = Σ r`` and ``S1 = Σ r x``, and one p×p matrix. The matrix is not summed
per time: a row stays in the risk set over ``(start, stop]``, so its share is
``r·(A(stop) - A(start))·x xᵀ`` with ``A`` the cumulative hazard. A step is
therefore

1. rows → ``p + 1`` sums per (stratum, time) in generated code, combined before
   the shuffle, and running sums over the distinct times;
2. rows joined to ``A`` at their two ends → one p×p cross-product, accumulated
   per task and added up by Spark.

The driver sees only the likelihood, the score and the p×p information.

Tied events follow Efron (default) or Breslow. ``tail`` rows stay at risk after
their stop with a weight that falls with time; Fine–Gray fits use them instead
of expanding the data (see :mod:`.finegray`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import cross_product, time_sums
from .risk import resolve_splits
from .scan import TIMES_PER_CHUNK, fits_broadcast, running, tie_sums
from ..sources.io import materialize

MAX_STEPS = 30
#: Tasks for a table of few times: it is worked out once a step, and empty tasks would take longer than the full ones.
FEW_TIMES_TASKS = 8
#: Up to so many terms the cross-product is summed in generated code, not handed to Python.
FEW_TERMS = 6
#: A term whose information is smaller than this share of its own after the terms before it is aliased.
ALIASED = 1e-9


def _exp(x: float) -> float:
    """e**x, infinite where a separated term makes it too large for a double."""
    return math.exp(x) if x < 709 else math.inf


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which none of ``cols`` is null."""
    return df.dropna(subset=list(cols))


@dataclass
class CoxModel:
    """A fitted model; ``hazard_table`` (distinct event times) is the only data it may keep."""

    spark: SparkSession
    terms: list[str]
    coef: np.ndarray
    naive_var: np.ndarray
    robust_var: np.ndarray | None
    loglik: tuple[float, float]
    n: int
    n_event: int
    steps: int
    converged: bool
    condition: float
    strata: list[str] = field(default_factory=list)
    hazard_table: DataFrame | None = None
    means: np.ndarray | None = None
    aliased: np.ndarray | None = None     # terms that the ones before them (or a constant) already say

    @property
    def var(self) -> np.ndarray:
        return self.naive_var if self.robust_var is None else self.robust_var

    def summary_rows(self, level: float = 0.95) -> list[tuple]:
        z_crit = NormalDist().inv_cdf(0.5 + level / 2)
        se = np.sqrt(np.diag(self.naive_var))
        rse = None if self.robust_var is None else np.sqrt(np.diag(self.robust_var))
        use = se if rse is None else rse
        rows = []
        for i, term in enumerate(self.terms):
            if self.aliased is not None and self.aliased[i]:
                rows.append((term, *[None] * 8, self.converged))
                continue
            b = float(self.coef[i])
            s = float(use[i])
            z = b / s if s > 0 else float("nan")
            rows.append((term, b, _exp(b), _exp(b - z_crit * s), _exp(b + z_crit * s),
                         float(se[i]), None if rse is None else float(rse[i]), z,
                         math.erfc(abs(z) / math.sqrt(2)), self.converged))
        return rows

    def summary(self) -> DataFrame:
        """``(term, coef, hr, lower, upper, se, robust_se, z, p, converged)``, one row per term.

        A term that is constant or a combination of the terms before it has nulls.
        ``converged`` is false for all terms of a fit that did not come to rest, as
        where a term separates events from the rest; its numbers are where it stopped.
        """
        return self.spark.createDataFrame(
            self.summary_rows(),
            "term string, coef double, hr double, lower double, upper double, "
            "se double, robust_se double, z double, p double, converged boolean")

    def baseline_hazard(self) -> DataFrame:
        """Cumulative baseline hazard ``(strata…, time, hazard)`` at the mean covariates."""
        if self.hazard_table is None:
            raise ValueError("fit with baseline=True to keep the baseline hazard")
        return self.hazard_table


def cox_fit(df: DataFrame, stop: str, status: str | Column, terms: Sequence[str],
            start: str | None = None, ties: str = "efron", strata: Sequence[str] = (),
            cluster: str | None = None, weight: str | None = None, robust: bool | None = None,
            splits="auto", tail: str | None = None, tail_weights: DataFrame | None = None,
            baseline: bool | None = None, tol: float = 1e-10,
            censoring: tuple[DataFrame, DataFrame] | None = None) -> CoxModel:
    """Fit ``hazard ~ terms``.

    ``status`` is a 0/1 column (or condition). ``strata`` get their own baseline.
    ``cluster`` gives the sandwich variance by cluster; with weights and no
    cluster it is computed by row, and ``robust=False`` turns it off. Rows with
    a null in any used column are left out.

    ``baseline`` keeps the cumulative baseline hazard (default: only without terms).

    ``tail`` is a row weight after ``stop`` (0 for ordinary rows) and
    ``tail_weights`` the table ``(time, g_before)`` it is multiplied with.
    ``censoring`` adds the uncertainty of these weights to a clustered sandwich:
    the table ``(time, n_risk, n_censor)`` of the censoring curve and the rows
    ``(_cluster, _start, _stop, _end)`` it was estimated from, ``_end`` being 1
    where a row ends in an event, 2 where it ends in a censoring, else 0.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be 'efron' or 'breslow'")
    status = F.col(status) if isinstance(status, str) else status
    if robust is None:
        robust = cluster is not None or weight is not None or tail is not None
    terms, strata, p = list(terms), list(strata), len(terms)

    cols = {
        "_stratum": _pack(strata),
        "_stop": F.col(stop),
        "_delta": status.cast("int"),
        "_w": F.lit(1.0) if weight is None else F.col(weight).cast("double"),
        **{f"x{j}": F.col(t).cast("double") for j, t in enumerate(terms)},
    }
    if start is not None:
        cols["_start"] = F.col(start)
    if cluster is not None:
        cols["_cluster"] = F.col(cluster)
    if tail is not None:
        cols["_tail"] = F.col(tail).cast("double")
    rows = df.dropna(subset=strata) if strata else df
    rows = rows.select(*[c.alias(n) for n, c in cols.items()]).dropna()
    rows = rows.where(F.col("_w") > 0)
    if start is not None:
        rows = rows.where(F.col("_start") < F.col("_stop"))
    rows, release = materialize(rows)
    try:
        fit = _Fit(rows, p, ties, start is not None, tail_weights, splits)
        fit.censoring = censoring
        keep = not terms if baseline is None else baseline
        return fit.run(df.sparkSession, terms, strata, cluster is not None, robust, keep, tol)
    finally:
        release()


def fit_together(fits: Mapping[str, Callable[[], CoxModel]], at_once: int = 4) -> dict[str, CoxModel]:
    """Run several fits side by side.

    The steps of one fit wait for each other and end in small jobs; those of
    another fit fill the executors meanwhile.
    """
    if not fits:
        return {}
    spark = SparkSession.active()
    with ThreadPoolExecutor(at_once) as pool:
        running_fits = {name: pool.submit(inheritable_thread_target(spark)(fit)) for name, fit in fits.items()}
        return {name: f.result() for name, f in running_fits.items()}


def _pack(strata: Sequence[str]) -> Column:
    if not strata:
        return F.lit(0)
    return F.col(strata[0]) if len(strata) == 1 else F.struct(*strata)


class _Fit:
    def __init__(self, rows, p, ties, has_start, tail_weights, splits):
        self.rows, self.p, self.ties = rows, p, ties
        self.has_start, self.tail_weights, self.censoring = has_start, tail_weights, None
        self.tail_rows = 0 if tail_weights is None else tail_weights.count()
        self.xs = [f"x{j}" for j in range(p)]
        # one job: sums per (stratum, stop), then over all of them
        each = [f"sum({v}) AS {n}_{x}" for x in self.xs
                for n, v in (("s", x), ("q", f"{x} * {x}"), ("e", f"_w * _delta * {x}"))]
        ends = [(f, f"{f}_{x}", x) for x in self.xs for f in ("min", "max")]
        by_stop = rows.groupBy("_stratum", "_stop").agg(*[F.expr(e) for e in (
            "count(1) AS n", "sum(_delta) AS d", "sum(_w * _delta) AS wd", *each, *[f"{f}({x}) AS {n}" for f, n, x in ends])])
        first = by_stop.agg(*[F.expr(e) for e in (
            "count(1) AS stops", "sum(n) AS n", "sum(d) AS d", "sum(wd) AS wd",
            *[f"sum({n}_{x}) AS {n}_{x}" for x in self.xs for n in "sqe"], *[f"{f}({n}) AS {n}" for f, n, _ in ends])]).first()
        if not first["n"] or not first["d"]:
            raise ValueError("no complete rows with an event")
        self.n, self.d = first["n"], first["d"]
        # the number of distinct times is known now: only a fine axis is measured further
        self.few = splits == "auto" and first["stops"] <= TIMES_PER_CHUNK
        self.splits = [] if self.few else resolve_splits(rows, "_stop", splits)
        self.times = first["stops"] * (2 if has_start else 1)   # starts add at most as many again
        self.means = np.array([first[f"s_{x}"] / self.n for x in self.xs])
        spread = np.array([first[f"q_{x}"] / self.n for x in self.xs]) - self.means ** 2
        self.scale = np.where(spread > 1e-12 * self.means ** 2, np.sqrt(np.maximum(spread, 0)), 1.0)
        self.low, self.high = ((np.array([first[f"{f}_{x}"] for x in self.xs]) - self.means) / self.scale for f in ("min", "max"))
        self.s = np.array([first[f"e_{x}"] for x in self.xs])
        self.s = (self.s - first["wd"] * self.means) / self.scale
        # every step works on centred, scaled covariates
        self.z = rows.withColumns({
            x: (F.col(x) - F.lit(float(self.means[j]))) / F.lit(float(self.scale[j]))
            for j, x in enumerate(self.xs)}) if p else rows

    # -- one point of the likelihood ---------------------------------------

    def shift(self, beta) -> float:
        """No row's linear predictor is larger: taken off before ``exp``, so nothing overflows.

        Risk-set sums and hazards carry it as a factor that cancels out wherever they meet.
        """
        return float(np.maximum(beta * self.low, beta * self.high).sum())

    def scored(self, beta) -> DataFrame:
        """Rows with the shifted linear predictor ``_lp`` and the weighted risk score ``_r``."""
        lp = " + ".join([f"{-self.shift(beta)!r}D", *[f"{float(b)!r}D * {x}" for b, x in zip(beta, self.xs)]])
        return self.z.selectExpr("*", f"{lp} AS _lp").selectExpr("*", "_w * exp(_lp) AS _r")

    def hazard(self, beta, residual_terms: bool = False) -> DataFrame:
        """Per (stratum, time): risk-set sums, hazard increments and their running sums.

        Columns: ``s, s_x`` sums over the risk set, ``e, e_x`` over tied events,
        ``d`` events (weighted), ``m`` tied rows, ``A`` cumulative hazard, ``B``
        the hazard still to come for tail rows.
        """
        xs, efron, tail = self.xs, self.ties == "efron", self.tail_weights is not None
        key = ["_stratum", "time"]
        ends = ["named_struct('time', _stop, 'sign', 1)"]
        if self.has_start:
            ends.append("named_struct('time', _start, 'sign', -1)")
        flat = self.scored(beta).selectExpr("*", f"inline(array({', '.join(ends)}))").selectExpr(
            "*", "sign * _r AS sr", "if(sign > 0 AND _delta = 1, 1D, 0D) AS hit",
            *(["if(sign > 0, _tail * exp(_lp), 0D) AS late"] if tail else []))

        def sums(name, factor):
            return [f"sum({factor}) AS {name}", *[f"sum({factor} * {x}) AS {name}_{x}" for x in xs]]

        wanted = [*sums("a", "sr"), "sum(hit * _w) AS d", "sum(hit) AS m", "sum(hit * _w * _lp) AS lpd"]
        wanted += sums("e", "hit * _r") if efron else []
        wanted += sums("q", "late") if tail else []
        grid = self.together(flat.groupBy(*key).agg(*[F.expr(w) for w in wanted]))

        each = ["", *[f"_{x}" for x in xs]]
        scans = {f"s{x}": ("sum_from", f"a{x}") for x in each}
        if tail:
            scans.update({f"k{x}": ("sum_before", f"q{x}") for x in each})
        grid = running(grid, ["_stratum"], "time", scans, self.splits, keep_chunk=True)
        keep = [*key, *(["_chunk"] if self.splits else []), "d", "m", "lpd", *([f"e{x}" for x in each] if efron else [])]
        if tail:
            g = self.tail_weights.selectExpr("time", "g_before AS g")
            g = F.broadcast(g) if fits_broadcast(self.tail_rows, 2) else g
            if residual_terms:    # competing rows before and at the time, for the uncertainty of the weights
                keep += [f"{c}{x}" for c in "kq" for x in each]
            grid = grid.join(g, "time", "left").selectExpr(
                *keep, "coalesce(g, 0D) AS g",
                *[f"s{x} + coalesce(g, 0D) * k{x} AS s{x}" for x in each])
            keep = [*keep, "g"]
        else:
            grid = grid.select(*keep, *[f"s{x}" for x in each])
        keep += [f"s{x}" for x in each]

        if efron:
            grid = tie_sums(grid, "m", "s", "e").selectExpr(
                "*", "if(d > 0, d / m, 0D) AS f")
        else:
            grid = grid.selectExpr(
                *keep, "if(d > 0, d, 0D) AS f", "if(d > 0, 1 / s, 0D) AS b0",
                "if(d > 0, 1 / (s * s), 0D) AS a0", "if(d > 0, ln(s), 0D) AS lq",
                "0D AS b1", "0D AS a1", "0D AS a2")

        more = ["f * b0 AS phi"]
        scans = {"A": ("sum", "phi")}
        if efron:
            more.append("f * b1 AS psi")
        if tail:
            more.append("g * f * b0 AS gphi")
            scans["B"] = ("sum_after", "gphi")
        if residual_terms:
            for x in xs:
                e = f"e_{x}" if efron else "0D"
                phi = f"f * (s_{x} * a0 - {e} * a1)"
                more += [f"if(d > 0, f / d * (s_{x} * b0 - {e} * b1), 0D) AS bar_{x}", f"{phi} AS phi_{x}"]
                scans[f"A_{x}"] = ("sum", f"phi_{x}")
                if efron:
                    more.append(f"f * (s_{x} * a1 - {e} * a2) AS psi_{x}")
                if tail:
                    more.append(f"g * {phi} AS gphi_{x}")
                    scans[f"B_{x}"] = ("sum_after", f"gphi_{x}")
        return self.together(running(grid.selectExpr("*", *more), ["_stratum"], "time", scans, self.splits))

    def together(self, grid) -> DataFrame:
        """A table of few times in few tasks."""
        return grid.coalesce(FEW_TIMES_TASKS) if self.few else grid

    def crossed(self, rows, h, xs, offset) -> DataFrame:
        """``(i, v)``: the entries of Σ h x xᵀ over the rows."""
        rows = rows.selectExpr(f"{h} AS _h", *xs)
        if self.p > FEW_TERMS:
            return rows.mapInArrow(cross_product(self.p, offset), "i int, v double")
        pairs = [(j, k) for j in range(self.p) for k in range(j, self.p)]
        one = rows.groupBy().agg(*[F.expr(f"coalesce(sum(_h * {xs[j]} * {xs[k]}), 0D) AS c{j}_{k}") for j, k in pairs])
        cells = [f"named_struct('i', {offset + j * self.p + k}, 'v', c{min(j, k)}_{max(j, k)})" for j in range(self.p) for k in range(self.p)]
        return one.selectExpr(f"inline(array({', '.join(cells)}))")

    def at_ends(self, rows, grid, at_stop, at_start) -> DataFrame:
        """Attach grid columns at each row's stop (suffix 1) and start (suffix 0)."""
        small = fits_broadcast(self.times, len(at_stop) + 2)
        if small:
            at_start = at_stop      # the same side twice: Spark broadcasts it once

        def side(key, cols, suffix):
            part = grid.select("_stratum", F.col("time").alias(key), *[F.col(c).alias(c + suffix) for c in cols])
            return F.broadcast(part) if small else part

        out = rows.join(side("_stop", at_stop, "1"), ["_stratum", "_stop"])
        if self.has_start:
            return out.join(side("_start", at_start, "0"), ["_stratum", "_start"])
        return out.selectExpr("*", *[f"0D AS {c}0" for c in at_start])

    def step_sums(self, beta):
        """Log-likelihood, score and information at ``beta``, in one job."""
        p, xs, efron, tail = self.p, self.xs, self.ties == "efron", self.tail_weights is not None
        grid = self.hazard(beta).persist()
        try:
            by_time = grid.where(F.col("d") > 0).select(
                "f", "b0", "a0", "lq", "lpd",
                *([F.col(c) for c in ("b1", "a1", "a2")] if efron else []),
                *[f"s_{x}" for x in xs], *([f"e_{x}" for x in xs] if efron else []))
            out = by_time.mapInArrow(time_sums(p, efron), "i int, v double")
            if p:
                rows = self.at_ends(self.scored(beta), grid,
                                    ["A", *(["psi"] if efron else []), *(["B"] if tail else [])],
                                    ["A"])
                h = "_r * (A1 - A0)"
                if efron:
                    h += " - if(_delta = 1, _r * psi1, 0D)"
                if tail:
                    h += " + _tail * exp(_lp) * B1"
                out = out.unionAll(self.crossed(rows, h, xs, 1 + p))
            total = np.zeros(1 + p + p * p)
            for i, v in out.groupBy("i").agg(F.sum("v")).collect():
                total[i] = v
        finally:
            grid.unpersist()
        return total[0], self.s - total[1:1 + p], total[1 + p:].reshape(p, p)

    # -- Newton ------------------------------------------------------------

    def run(self, spark, terms, strata, clustered, robust, baseline, tol) -> CoxModel:
        p = self.p
        beta = np.zeros(p)
        ll, u, info = self.step_sums(beta)
        free = _independent(info)
        null_ll, steps, converged = ll, 0, not free.any()
        while not converged and steps < MAX_STEPS:
            step = np.zeros(p)
            step[free] = _solve(info[np.ix_(free, free)], u[free])
            steps += 1
            if np.max(np.abs(step)) <= tol:
                beta, converged = beta + step, True
                break
            new = beta + step
            new_ll, new_u, new_info = self.step_sums(new)
            halvings = 0
            while not (new_ll >= ll - 1e-9 * abs(ll)) and halvings < 10:     # also where sums left the range of doubles
                step, halvings = step / 2, halvings + 1
                new = beta + step
                new_ll, new_u, new_info = self.step_sums(new)
            if not new_ll >= ll - 1e-9 * abs(ll):
                break
            # a likelihood that no longer moves while a coefficient runs off: separation
            stalled = abs(new_ll - ll) <= 1e-12 * abs(ll) and np.max(np.abs(step)) > 1e-3
            beta, ll, u, info = new, new_ll, new_u, new_info
            if stalled:
                break
        var = np.zeros((p, p))
        var[np.ix_(free, free)] = _inverse(info[np.ix_(free, free)])
        rvar = self.sandwich(beta, var, clustered) if robust and p else None
        to_raw = np.outer(1 / self.scale, 1 / self.scale) if p else 1.0
        table = None
        if baseline:
            table, _ = materialize(self.hazard(beta).where(F.col("d") > 0).select(
                *_unpack(strata), "time", (F.col("A") * math.exp(-self.shift(beta))).alias("hazard")))
            table.count()       # evaluated now: the rows behind it are freed after the fit
        return CoxModel(
            spark, terms, beta / self.scale, var * to_raw, None if rvar is None else rvar * to_raw,
            (null_ll, ll), self.n, self.d, steps, converged,
            float(np.linalg.cond(info[np.ix_(free, free)])) if free.any() else 1.0, strata, table, self.means, ~free)

    def sandwich(self, beta, var, clustered) -> np.ndarray:
        """``V (Σ L Lᵀ) V`` with the score residuals ``L`` summed per cluster."""
        xs, efron, tail = self.xs, self.ties == "efron", self.tail_weights is not None
        grid = self.hazard(beta, residual_terms=True).persist()
        try:
            at_stop = ["A", *[f"A_{x}" for x in xs], *[f"bar_{x}" for x in xs]]
            if efron:
                at_stop += ["psi", *[f"psi_{x}" for x in xs]]
            if tail:
                at_stop += ["B", *[f"B_{x}" for x in xs]]
            rows = self.at_ends(self.scored(beta), grid, at_stop, ["A", *[f"A_{x}" for x in xs]])
            parts = []
            for x in xs:
                part = (f"if(_delta = 1, _w * ({x} - bar_{x}1), 0D)"
                        f" - _r * ({x} * (A1 - A0) - (A_{x}1 - A_{x}0))")
                if efron:
                    part += f" + if(_delta = 1, _r * ({x} * psi1 - psi_{x}1), 0D)"
                if tail:
                    part += f" - _tail * exp(_lp) * ({x} * B1 - B_{x}1)"
                parts.append(part)
            if clustered and self.censoring:
                parts_by_row = rows.selectExpr("_cluster", *[f"{v} AS {x}" for x, v in zip(xs, parts)])
                res = parts_by_row.unionByName(self.weight_influence(grid)).groupBy("_cluster").agg(
                    *[F.sum(x).alias(x) for x in xs])
            elif clustered:
                res = rows.groupBy("_cluster").agg(*[F.expr(f"sum({v}) AS {x}") for x, v in zip(xs, parts)])
            else:
                res = rows.selectExpr(*[f"{v} AS {x}" for x, v in zip(xs, parts)])
            sums = self.crossed(res, "1D", xs, 0).groupBy("i").agg(F.sum("v")).collect()
        finally:
            grid.unpersist()
        meat = np.zeros(self.p * self.p)
        for i, v in sums:
            meat[i] = v
        return var @ meat.reshape(self.p, self.p) @ var


    def weight_influence(self, grid) -> DataFrame:
        """(``_cluster``, x…): what each row adds to the score through the estimated censoring curve.

        A competing row at ``v`` counts at ``s > v`` with the product of ``1 - c/y``
        over censoring times ``v ≤ u < s``. A row in the risk set of a censoring
        time ``u`` moves that factor, and with it all pairs ``v ≤ u < s``; their
        part of the score is ``K_x(u)·B(u) - K(u)·B_x(u)``: competing rows up to
        ``u`` and hazard after ``u``, two scans in opposite directions. The martingale
        sum of a row over its own time at risk is a running sum at its two ends.
        """
        xs, (curve, rows) = self.xs, self.censoring
        # the change of that product at each time of each stratum; times in between keep the value
        change = {x: f"(k_{x} + q_{x}) * B - (k + q) * B_{x} - k_{x} * (B + gphi) + k * (B_{x} + gphi_{x})" for x in xs}
        none = [f"0D AS {x}" for x in xs]
        steps = grid.selectExpr("time", *[f"{v} AS {x}" for x, v in change.items()], "0D AS y", "0D AS c")
        steps = steps.unionAll(curve.selectExpr("time", *none, "double(n_risk) AS y", "double(n_censor) AS c"))
        if "_start" in rows.columns:
            steps = steps.unionAll(rows.select(F.col("_start").alias("time")).distinct().selectExpr("time", *none, "0D AS y", "0D AS c"))
        steps = steps.groupBy("time").agg(*[F.sum(x).alias(x) for x in xs], F.max("y").alias("y"), F.max("c").alias("c"))
        steps = running(steps, [], "time", {f"q_{x}": ("sum", x) for x in xs}, self.splits, keep_chunk=True)
        # no factor is left where all at risk are censored
        steps = steps.selectExpr("*", *[f"if(c > 0 AND y > c, q_{x} / (y - c), 0D) AS h_{x}" for x in xs])
        steps = steps.selectExpr("*", *[f"if(c > 0, h_{x} * c / y, 0D) AS l_{x}" for x in xs])
        steps = running(steps, [], "time", {f"C_{x}": ("sum", f"l_{x}") for x in xs}, self.splits)
        small = fits_broadcast(steps.count(), 3 * len(xs) + 1)

        def side(key, cols):
            part = steps.select(F.col("time").alias(key), *cols)
            return F.broadcast(part) if small else part

        out = rows.join(side("_stop", [f"{c}_{x}" for c in "hlC" for x in xs]), "_stop")
        value = {x: f"if(_end = 2, h_{x}, 0D) + if(_end = 1, l_{x}, 0D) - C_{x}" for x in xs}
        if "_start" in rows.columns:
            out = out.join(side("_start", [F.col(f"C_{x}").alias(f"C0_{x}") for x in xs]), "_start")
            value = {x: f"{v} + C0_{x}" for x, v in value.items()}
        return out.selectExpr("_cluster", *[f"{v} AS {x}" for x, v in value.items()])


def _unpack(strata: Sequence[str]) -> list[Column]:
    if not strata:
        return []
    if len(strata) == 1:
        return [F.col("_stratum").alias(strata[0])]
    return [F.col(f"_stratum.{s}").alias(s) for s in strata]


# --- driver-side p×p algebra ----------------------------------------------


def _independent(info: np.ndarray) -> np.ndarray:
    """Which terms add information to those before them: elimination in the order of the terms."""
    left, free = info.copy(), np.zeros(len(info), bool)
    for j in range(len(info)):
        if left[j, j] > ALIASED * max(info[j, j], 1e-300) and left[j, j] > 1e-12 * np.max(np.diag(info)):
            free[j] = True
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return free


def _solve(info: np.ndarray, u: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(info, u)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(info, u, rcond=None)[0]


def _inverse(info: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(info)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(info)

