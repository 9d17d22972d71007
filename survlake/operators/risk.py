"""Risk tables and the non-parametric estimators built on them.

The data is read once and collapsed to distinct times by a combining
aggregate; every estimator is then a running sum or product over those times.
Events come before censorings at the same time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import TIMES_PER_CHUNK, running, tie_sums, time_splits

START, STOP, STATUS, CAUSE = "surv_start", "surv_stop", "surv_status", "surv_cause"


def survival_response(df: DataFrame, stop: str, cause: str, endpoint: int | str = "any",
                      start: str | None = None, censor: int = 0) -> DataFrame:
    """Add ``surv_start, surv_stop, surv_status, surv_cause``.

    ``endpoint`` is one cause code or ``'any'``; every other code counts as
    censored. Rows without a time or cause are dropped.
    """
    hit = (F.col(cause) != censor) if endpoint == "any" else (F.col(cause) == endpoint)
    out = df.withColumns({
        STOP: F.col(stop), CAUSE: F.col(cause), STATUS: hit.cast("int")})
    need = [STOP, CAUSE]
    if start is not None:
        out = out.withColumn(START, F.col(start))
        need.append(START)
    return out.dropna(subset=need)


def combined_endpoint(df: DataFrame, cause: str, codes: Sequence, out: str, event=1, censor=0) -> DataFrame:
    """Merge several causes into one event code."""
    return df.withColumn(out, F.when(F.col(cause).isin(list(codes)), F.lit(event)).otherwise(F.lit(censor)))


def relevel_event(df: DataFrame, event: str, censor_level: str, levels: Sequence[str],
                  out: str = "event_code") -> DataFrame:
    """Text event to codes with the chosen censoring level first (code 0)."""
    rest = [v for v in levels if v != censor_level]
    code = F.when(F.col(event) == censor_level, 0)
    for i, level in enumerate(rest, 1):
        code = code.when(F.col(event) == level, i)
    return df.withColumn(out, code)


def resolve_splits(df: DataFrame, col: str, splits) -> list:
    """``'auto'``: the distinct values of any axis are measured, and a fine-grained
    one is cut into chunks; a number's type says nothing about how fine it is."""
    if splits != "auto":
        return list(splits or [])
    return time_splits(df, col)


def risk_table(resp: DataFrame, strata: Sequence[str] = (), weight: str | None = None,
               causes: Sequence[int] | None = None, last: Column | None = None,
               splits="auto") -> DataFrame:
    """Per stratum and time: ``n_risk``, ``n_event``, ``n_tied``, ``n_censor``.

    A row is at risk at ``t`` when ``start < t <= stop``, so it adds at its stop
    and removes at its start, and ``n_risk`` is the sum from ``t`` on.
    ``n_event`` and ``n_censor`` are weighted, ``n_tied`` counts event rows.
    ``causes`` adds ``n_event_<k>`` per code. ``last`` says which rows end a
    subject; only those can be censored (default: every row).
    """
    return _risk_grid(resp, list(strata), weight, causes, last, splits)[0].drop("_chunk")


_held: list[DataFrame] = []     # collapsed tables that were counted and will be scanned, the latest ones
HELD = 8


def _hold(grid: DataFrame) -> DataFrame:
    """``grid`` cached for the scan after its count; of several only the last ``HELD`` stay cached."""
    app = grid.sparkSession.sparkContext.applicationId
    _held[:] = [g for g in _held if g.sparkSession.sparkContext._jsc and g.sparkSession.sparkContext.applicationId == app]
    while len(_held) >= HELD:
        _held.pop(0).unpersist()
    _held.append(grid.persist())
    return grid


def _risk_grid(resp, strata, weight, causes, last, splits) -> tuple[DataFrame, list]:
    """The risk table, with the scan's chunk column where the time axis is cut, and the cuts.

    ``'auto'`` counts the table that is collapsed to distinct times, which the scan
    then reads: the rows themselves are evaluated once.
    """
    if strata:
        resp = resp.dropna(subset=strata)
    if weight is not None:
        resp = resp.where(F.col(weight) > 0)
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("double")
    zero = F.lit(0).cast("long") if weight is None else F.lit(0.0)
    event = F.col(STATUS) == 1
    ends = F.lit(True) if last is None else last

    def entry(at, n, on):
        tally = {
            "n_event": F.when(event, w).otherwise(zero),
            "n_tied": event.cast("long"),
            "n_censor": F.when((F.col(CAUSE) == 0) & ends, w).otherwise(zero),
            **{f"n_event_{k}": F.when(F.col(CAUSE) == k, w).otherwise(zero) for k in causes or ()},
            "_stop": F.lit(1),
        }
        return F.struct(at.alias("time"), n.alias("_n"), *[
            (v if on else v * 0).alias(k) for k, v in tally.items()])

    entries = [entry(F.col(STOP), w, True)]
    if START in resp.columns:
        entries.append(entry(F.col(START), -w, False))
    flat = resp.select(*strata, F.explode(F.array(*entries)).alias("_e")).select(*strata, "_e.*")
    measures = [c for c in flat.columns if c not in (*strata, "time")]
    grid = flat.groupBy(*strata, "time").agg(*[F.sum(c).alias(c) for c in measures])
    if splits == "auto":
        grid = _hold(grid)
        splits = [] if grid.count() <= TIMES_PER_CHUNK else time_splits(grid, "time")
    splits = list(splits or [])
    grid = running(grid, strata, "time", {"n_risk": ("sum_from", "_n")}, splits, keep_chunk=True)
    keep = [c for c in measures if not c.startswith("_")]
    keep += ["_chunk"] if splits else []
    return grid.where(F.col("_stop") > 0).select(*strata, "time", "n_risk", *keep), splits


def kaplan_meier(resp: DataFrame, strata: Sequence[str] = (), weight: str | None = None,
                 splits="auto") -> DataFrame:
    """``(strata, time, n_risk, n_event, n_censor, surv)``."""
    rt, splits = _risk_grid(resp, list(strata), weight, None, None, splits)
    rt = rt.withColumn("_f", 1 - F.col("n_event") / F.col("n_risk"))
    out = running(rt, list(strata), "time", {"surv": ("product", "_f")}, splits)
    return out.drop("_f", "n_tied")


def nelson_aalen(resp: DataFrame, strata: Sequence[str] = (), weight: str | None = None,
                 ties: str = "breslow", splits="auto") -> DataFrame:
    """Cumulative hazard: ``(strata, time, n_risk, n_event, hazard)``.

    ``ties='efron'`` lowers the risk set step by step over tied events.
    """
    strata = list(strata)
    rt, splits = _risk_grid(resp, strata, weight, None, None, splits)
    if ties == "efron":
        rt = tie_sums(rt, "n_tied", "n_risk", "n_event")
        rt = rt.withColumn("_h", F.when(F.col("n_tied") > 0, F.col("n_event") / F.col("n_tied") * F.col("b0"))
                           .otherwise(0.0))
    elif ties == "breslow":
        rt = rt.withColumn("_h", F.col("n_event") / F.col("n_risk"))
    else:
        raise ValueError("ties must be 'breslow' or 'efron'")
    out = running(rt, strata, "time", {"hazard": ("sum", "_h")}, splits)
    return out.select(*strata, "time", "n_risk", "n_event", "hazard")


def cumulative_incidence(df: DataFrame, time: str, cause: str, causes: Sequence[int] = (1, 2),
                         strata: Sequence[str] = (), splits="auto") -> DataFrame:
    """Cumulative incidence per cause under competing risks: ``(strata, time, cause, est)``."""
    resp = survival_response(df, time, cause)
    strata = list(strata)
    rt, splits = _risk_grid(resp, strata, None, causes, None, splits)
    rt = rt.withColumn("_f", 1 - F.col("n_event") / F.col("n_risk"))
    rt = running(rt, strata, "time", {"_before": ("product_before", "_f")}, splits, keep_chunk=True)
    rt = rt.withColumns({
        f"_i_{k}": F.col("_before") * F.col(f"n_event_{k}") / F.col("n_risk") for k in causes})
    rt = running(rt, strata, "time", {f"_c_{k}": ("sum", f"_i_{k}") for k in causes}, splits)
    return rt.select(*strata, "time", F.explode(F.array(*[
        F.struct(F.lit(k).alias("cause"), F.col(f"_c_{k}").alias("est")) for k in causes
    ])).alias("_s")).select(*strata, "time", "_s.*")


def compare_km_cif(df: DataFrame, time: str, cause: str, labels: Mapping[int, str],
                   both: str, splits="auto") -> DataFrame:
    """``1 - KM`` next to the cumulative incidence, per cause and for any cause.

    All series come from one risk table, so the data is read once.
    Output: ``(which_est, which_event, time, est)``.
    """
    codes = list(labels)
    resp = survival_response(df, time, cause)
    rt, splits = _risk_grid(resp, [], None, codes, None, splits)
    rt = rt.withColumns({
        "_f": 1 - F.col("n_event") / F.col("n_risk"),
        **{f"_f_{k}": 1 - F.col(f"n_event_{k}") / F.col("n_risk") for k in codes}})
    rt = running(rt, [], "time", {
        "_before": ("product_before", "_f"), "_km": ("product", "_f"),
        **{f"_km_{k}": ("product", f"_f_{k}") for k in codes}}, splits, keep_chunk=True)
    rt = rt.withColumns({
        "_i": F.col("_before") * F.col("n_event") / F.col("n_risk"),
        **{f"_i_{k}": F.col("_before") * F.col(f"n_event_{k}") / F.col("n_risk") for k in codes}})
    rt = running(rt, [], "time", {
        "_cif": ("sum", "_i"), **{f"_cif_{k}": ("sum", f"_i_{k}") for k in codes}}, splits)

    def series(est, event, value):
        return F.struct(F.lit(est).alias("which_est"), F.lit(event).alias("which_event"),
                        value.alias("est"))

    stack = [series("1 - KM", both, 1 - F.col("_km")), series("CIF", both, F.col("_cif"))]
    for k, label in labels.items():
        stack += [series("1 - KM", label, 1 - F.col(f"_km_{k}")), series("CIF", label, F.col(f"_cif_{k}"))]
    return rt.select("time", F.explode(F.array(*stack)).alias("_s")).select(
        "_s.which_est", "_s.which_event", "time", "_s.est")


def censoring_weights(df: DataFrame, time: str, cause: str, start: str | None = None,
                      final: str | None = None, strata: Sequence[str] = (), splits="auto") -> DataFrame:
    """Kaplan–Meier of the censoring distribution: ``(time, n_risk, n_event, n_censor, g_before, g)``.

    The risk set of a censoring leaves out the events of the same time. With
    interval rows, ``final`` names the subject's last time: only a row that
    reaches it can be a censoring.
    """
    resp = survival_response(df, time, cause, start=start)
    last = None if final is None else F.col(final) == F.col(STOP)
    rt, splits = _risk_grid(resp, list(strata), None, None, last, splits)
    rt = rt.withColumn("_f", F.when(
        F.col("n_censor") > 0, 1 - F.col("n_censor") / (F.col("n_risk") - F.col("n_event"))).otherwise(1.0))
    out = running(rt, list(strata), "time", {
        "g_before": ("product_before", "_f"), "g": ("product", "_f")}, splits)
    return out.drop("_f", "n_tied")
