"""Landmark data sets and super-models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cox import CoxModel, cox_fit


def landmark_grid(first: int, last: int, step: int) -> list[int]:
    """Landmark times ``first, first + step, …, last``."""
    return list(range(first, last + 1, step))


def landmark_cut(cp: DataFrame, grid: Sequence[int], horizon: int, status: str,
                 start: str = "start_time", end: str = "end_time", time: str = "time",
                 closed: str = "left", out: str = "LM") -> DataFrame:
    """The stack of all landmarks: who is still at risk, with covariates as known then.

    On interval rows the last values before a landmark are those of the interval
    ``start < LM <= end`` (``closed='right'``: ``start <= LM < end``), so each
    row emits the landmarks it covers: no join, no shuffle, no ranking. Follow-up
    is cut at ``LM + horizon``; ``status`` becomes 0 where that cuts it off.

    Adds ``LM, Tstart, LM1`` (= s) and ``LM2`` (= s²).
    """
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    times = F.array(*[F.lit(int(t)) for t in grid])
    if closed == "left":
        covered = F.filter(times, lambda t: (t > F.col(start)) & (t <= F.col(end)) & (t < F.col(time)))
    else:
        covered = F.filter(times, lambda t: (t >= F.col(start)) & (t < F.col(end)) & (t < F.col(time)))
    stack = cp.withColumn(out, F.explode(covered))
    limit = F.col(out) + horizon
    return stack.withColumns({
        status: F.when(F.col(time) > limit, 0).otherwise(F.col(status)),
        time: F.least(F.col(time), limit),
        "Tstart": F.col(out),
        "LM1": F.col(out),
        "LM2": F.col(out) * F.col(out),
    })


def landmark_counts(stack: DataFrame, col: str, landmark: str = "LM") -> DataFrame:
    """Subjects per landmark and category; null is a category of its own."""
    return stack.groupBy(landmark, col).agg(F.count(F.lit(1)).alias("n"))


def landmark_supermodel(stack: DataFrame, terms: Sequence[str], status, id: str,
                        form: str = "strata", time: str = "time", landmark: str = "LM",
                        **options) -> CoxModel:
    """One model over all landmarks, sandwich variance by subject, Breslow ties.

    ``form='strata'`` gives each landmark its own baseline, ``'poly'`` one
    baseline and the terms ``LM1``, ``LM2``.
    """
    if form == "strata":
        return cox_fit(stack, time, status, terms, start="Tstart", ties="breslow",
                       strata=[landmark], cluster=id, **options)
    if form == "poly":
        return cox_fit(stack, time, status, [*terms, "LM1", "LM2"], start="Tstart", ties="breslow",
                       cluster=id, **options)
    raise ValueError("form must be 'strata' or 'poly'")
