"""Fine–Gray: the weighted expansion as a table, and fits that do without it.

A subject with a competing event at ``u`` stays at risk at ``t > u`` with weight
``G(t-)/G(u-)``, ``G`` being the Kaplan–Meier of the censoring distribution.
The expanded table has (competing rows × later censoring steps) rows. A fit
does not need it: the extra risk-set sums factor into ``G(t-)`` times a running
sum of ``r/G(u-)`` over earlier competing rows, which is one more scan over the
distinct times (``tail`` rows of :func:`.cox.cox_fit`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cox import CoxModel, cox_fit
from .risk import censoring_weights, resolve_splits
from .scan import fits_broadcast, running
from ..sources.io import materialize


def finegray_expand(df: DataFrame, cause: int, event: str, stop: str, start: str | None = None,
                    final: str | None = None, splits="auto") -> DataFrame:
    """The weighted counting-process table of one cause.

    Adds ``fgstart, fgstop, fgstatus, fgwt`` to the input columns. Rows that end
    otherwise than in a competing event appear once with weight 1. A competing
    row appears once up to its own time and once per later stretch between
    censoring times; stretches without an event of ``cause`` are left out.
    ``event`` is 0 for censored; ``final`` (the subject's last time) is needed
    when a subject has several rows.
    """
    keep = df.columns
    splits = resolve_splits(df, stop, splits)
    begin = F.lit(0) if start is None else F.col(start)
    grid = _steps(df, cause, event, stop, start, final, splits)
    own = df.select(*keep, begin.alias("fgstart"), F.col(stop).alias("fgstop"),
                    (F.col(event) == cause).cast("int").alias("fgstatus"), F.lit(1.0).alias("fgwt"))

    steps = grid.where(F.col("_kept")).groupBy("_rank").agg(
        F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("g_before").alias("_g"))
    at = grid.select(F.col("time").alias("_u"), F.col("g_before").alias("_gu"),
                     F.col("_first"), F.col("_n_kept"))
    if not splits:      # few times, as counted: the rivals, which hold nearly all of the result, stay where they are
        at, steps = F.broadcast(at), F.broadcast(steps)
    rivals = df.where(~F.col(event).isin(0, cause)).withColumn("_u", F.col(stop))
    late = (rivals.join(at, "_u").where(F.col("_first") <= F.col("_n_kept"))
            .withColumn("_rank", F.explode(F.sequence("_first", "_n_kept")))
            .join(steps, "_rank").where(F.col("_hi") > F.col("_u")))
    late = late.select(*keep, F.greatest("_lo", "_u").alias("fgstart"), F.col("_hi").alias("fgstop"),
                       F.lit(0).alias("fgstatus"), (F.col("_g") / F.col("_gu")).alias("fgwt"))
    return own.unionByName(late)


def _steps(df, cause, event, stop, start, final, splits) -> DataFrame:
    """Every distinct time with the stretch between censoring times it lies in.

    ``_rank`` numbers the stretches that hold an event of ``cause``; ``_first``
    is the first such number not before this time.
    """
    g = censoring_weights(df, stop, event, start=start, final=final, splits=splits)
    focal = df.where(F.col(event) == cause).groupBy(F.col(stop).alias("time")).agg(
        F.count(F.lit(1)).alias("_focal"))
    g = g.join(focal, "time", "left").withColumn("_cut", (F.col("n_censor") > 0).cast("int"))
    g = running(g, [], "time", {"_step": ("sum_before", "_cut")}, splits)
    stretch = g.groupBy("_step").agg(F.max("time").alias("_hi"), F.max("_focal").alias("_f"))
    stretch = running(
        stretch.withColumns({"_kept": F.col("_f").isNotNull(), "_one": F.when(F.col("_f").isNotNull(), 1).otherwise(0)}),
        [], "_step", {"_rank": ("sum", "_one"), "_earlier": ("sum_before", "_one")})
    w = Window.partitionBy(F.lit(0))
    stretch = stretch.select(
        "_step", "_hi", "_kept", F.col("_rank").cast("int").alias("_rank"),
        (F.col("_earlier") + 1).cast("int").alias("_first"),
        F.coalesce(F.lag("_hi").over(w.orderBy("_step")), F.lit(0)).alias("_lo"),
        F.sum("_one").over(w).cast("int").alias("_n_kept"))
    return g.join(stretch, "_step")


def finegray_fit(df: DataFrame, stop: str, event: str, cause: int, terms: Sequence[str],
                 start: str | None = None, final: str | None = None, id: str | None = None,
                 ties: str = "efron", splits="auto", censoring_term: bool = True, **options) -> CoxModel:
    """Subdistribution hazard model of one cause.

    Fixed covariates: one row per subject. Time-varying: ``start`` and ``final``
    given, and a subject keeps its last covariates after a competing event. The
    weights use every row, before rows with a missing term are dropped.

    With ``id`` the variance is the sandwich by subject, without by input row.
    It contains the uncertainty of the censoring curve: what each subject, also
    one without complete terms, adds to the score by moving the weights of
    others. ``censoring_term=False`` takes the weights as known.
    """
    robust = options.get("robust") is not False and bool(terms)
    rows = df
    if id is None and robust:
        id, rows = "_row", df.withColumn("_row", F.monotonically_increasing_id())
    # read by the curve, the fit and the variance: evaluated once
    rows, release = materialize(rows)
    curve = censoring_weights(rows, stop, event, start=start, final=final, splits=splits)
    curve = curve.selectExpr("time", "g_before", "n_risk - n_event AS n_risk", "n_censor").persist()
    try:
        at = curve.select(F.col("time").alias("_u"), F.col("g_before").alias("_gu"))
        at = F.broadcast(at) if fits_broadcast(curve.count(), 2) else at
        rival = ~F.col(event).isin(0, cause)
        late = rows.withColumn("_u", F.col(stop)).join(at, "_u", "left").withColumn(
            "_late", F.when(rival, 1.0 / F.col("_gu")).otherwise(0.0)).drop("_u", "_gu")
        censoring = None
        if robust and censoring_term:
            reached = F.lit(True) if final is None else F.col(final) == F.col(stop)
            end = F.when(F.col(event) != 0, 1).when(reached, 2).otherwise(0)
            ends = rows.select(F.col(id).alias("_cluster"), *([F.col(start).alias("_start")] if start else []),
                               F.col(stop).alias("_stop"), end.alias("_end"), F.col(event).alias("_event")).dropna(
                subset=["_stop", "_event", *(["_start"] if start else [])])
            censoring = curve, ends.drop("_event")
        return cox_fit(late, stop, F.col(event) == cause, terms, start=start, ties=ties, cluster=id if robust else None,
                       tail="_late", tail_weights=curve.select("time", "g_before"), splits=splits, censoring=censoring, **options)
    finally:
        curve.unpersist()
        release()
