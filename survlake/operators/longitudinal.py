"""Per-subject longitudinal operators: carry-forward, neighbours, intervals.

``first_per_group``-style picks are written as a rank filter, which Spark
limits per map task before the shuffle, so a hot subject does not pile up.
Ordered scans over a subject take a ``chunk`` key (see :mod:`.scan`); without
one a subject's rows meet in one task, which is fine once there is at most one
row per subject and calendar day (:func:`dedupe_by_key` on ``(id, date)``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gt_missing_low, nullify
from .scan import adjacent_values, carry_forward, next_value


def locf(df: DataFrame, id: str, order_by: Sequence[str], cols: Sequence[str],
         sentinels: Mapping[str, Sequence] | None = None, sentinel_after: bool = False,
         chunk: Column | None = None) -> DataFrame:
    """Carry the last non-null value forward within a subject.

    ``sentinels`` (column → values that mean missing) are blanked before the
    carry, so they are filled like any gap. ``sentinel_after=True`` blanks them
    afterwards: a sentinel is then carried first and ends up null.
    """
    marks = dict(sentinels or {})
    if not sentinel_after:
        for c, values in marks.items():
            df = nullify(df, [c], values)
    df = carry_forward(df, id, order_by, cols, chunk)
    if sentinel_after:
        for c, values in marks.items():
            df = nullify(df, [c], values)
    return df


def neighbor_visits(df: DataFrame, id: str, order_by: Sequence[str], cols: Sequence[str],
                    chunk: Column | None = None) -> DataFrame:
    """Add ``prev_<col>`` and ``post_<col>`` of the adjacent visits."""
    return adjacent_values(df, id, order_by, before={f"prev_{c}": c for c in cols},
                           after={f"post_{c}": c for c in cols}, chunk=chunk)


def _ranked(df: DataFrame, keys: Sequence[str], order_by: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def first_per_group(df: DataFrame, id: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row per subject; ``order_by`` should break ties."""
    keys = [id] if isinstance(id, str) else list(id)
    return _ranked(df, keys, [F.col(c).asc_nulls_first() for c in order_by])


def last_per_group(df: DataFrame, id: str | Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Last row per subject."""
    keys = [id] if isinstance(id, str) else list(id)
    return _ranked(df, keys, [F.col(c).desc_nulls_last() for c in order_by])


def dedupe_by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, deterministically the first in ``order_by``."""
    return first_per_group(df, keys, order_by)


def expand_days(df: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row per day in ``[start, end - 1]``; empty intervals give no row.

    For counts and rates per day use :func:`..describe.daily_prevalence`, which
    never builds these rows.
    """
    last = F.col(end) - 1
    return (df.where(F.col(start) <= last)
            .withColumn(out, F.explode(F.sequence(F.col(start).cast("int"), last.cast("int")))))


def counting_process(df: DataFrame, id: str, visit: str, origin: str, final: str,
                     status: str, chunk: Column | None = None) -> DataFrame:
    """Visits to ``(start_time, end_time]`` intervals in days since ``origin``.

    Needs one row per ``(id, visit date)`` and raises on a second one: the same
    scan that finds the next visit sees it. An interval runs to the next visit, the
    last one to ``final``. Visits on the final date are dropped after the
    next dates were taken, so the interval before them carries the event.
    ``event_numeric`` is ``status`` on the interval that ends at ``final``, else 0.
    """
    df = next_value(df, id, [visit], {"post_date": visit}, chunk)
    twice = F.concat(F.lit(f"two visits of one {id} on one {visit}: "), F.concat_ws(", ", F.col(id).cast("string"), F.col(visit).cast("string")))
    df = df.where(F.when(F.col("post_date") == F.col(visit), F.raise_error(twice).cast("boolean"))
                  .otherwise(F.col(visit) != F.col(final)))
    df = df.withColumn("post_date", F.coalesce("post_date", final))
    return df.withColumns({
        "time": F.datediff(final, origin),
        "start_time": F.datediff(visit, origin),
        "end_time": F.datediff("post_date", origin),
        "event_numeric": F.when(F.col("post_date") == F.col(final), F.col(status)).otherwise(0),
    })


def baseline_rows(cp: DataFrame, id: str, status: str) -> DataFrame:
    """First interval per subject, with the subject's final status as event."""
    return first_per_group(cp, id, ["start_time"]).withColumn("event_numeric", F.col(status))


def vanished_subjects(before: DataFrame, after: DataFrame, id: str) -> DataFrame:
    """Subjects of ``before`` that have no row in ``after``, with the number of rows they had.

    Both sides are counted before the shuffle and meet in one aggregate, so no row
    of either is joined.
    """
    sides = [df.where(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(k))
             for k, df in enumerate((before, after))]
    n = [F.sum(F.when(F.col("_side") == k, F.col("_n"))).alias(c) for k, c in enumerate(("n_rows", "_kept"))]
    return sides[0].unionByName(sides[1]).groupBy(id).agg(*n).where(F.col("_kept").isNull()).drop("_kept")


def next_state(df: DataFrame, id: str, order_by: Sequence[str], state: str, out: str,
               terminal: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """State at the following visit.

    A terminal event overrides it; the last visit (and a visit followed by an
    unknown state) falls back to its own state.
    """
    df = next_value(df, id, order_by, {out: state}, chunk)
    parts = [F.col(out), F.col(state)] if terminal is None else [terminal, F.col(out), F.col(state)]
    return df.withColumn(out, F.coalesce(*parts))


def diagnostic_visit(df: DataFrame, value: str, prev_value: str, cols: Sequence[str],
                     threshold: float, prefix: str = "diagnostic_") -> DataFrame:
    """Take the previous visit where its value was higher, else the current one.

    Missing sorts lowest: a present previous value beats a missing current one.
    ``cols`` are the columns to choose (each needs a ``prev_`` twin). Rows whose
    chosen value is below ``threshold`` or missing are dropped.
    """
    earlier = gt_missing_low(prev_value, value)
    picks = {f"{prefix}{c}": F.when(earlier, F.col(f"prev_{c}")).otherwise(F.col(c)) for c in cols}
    picks[f"{prefix}{value}"] = F.when(earlier, F.col(prev_value)).otherwise(F.col(value))
    return df.withColumns(picks).where(F.col(f"{prefix}{value}") >= threshold)


def final_event_date(df: DataFrame, status: str, dates: Mapping[int, str], out: str) -> DataFrame:
    """Pick the date column that belongs to the status code."""
    return df.withColumn(out, F.coalesce(
        *[F.when(F.col(status) == code, F.col(c)) for code, c in dates.items()]))


def response_label(df: DataFrame, value: str, threshold: float, out: str) -> DataFrame:
    """``Response`` below the threshold, ``No response`` from it on, null if missing."""
    return df.withColumn(out, F.when(F.col(value) < threshold, "Response")
                         .when(F.col(value) >= threshold, "No response"))


def any_by_subject(df: DataFrame, id: str, flags: Sequence[str], prefix: str = "any_") -> DataFrame:
    """Per subject: was the flag ever set?"""
    return df.groupBy(id).agg(
        *[F.coalesce(F.max((F.col(c) > 0).cast("int")), F.lit(0)).alias(prefix + c) for c in flags])


def union_cohorts(tables: Mapping[str, DataFrame], tag: str | None = None) -> DataFrame:
    """Stack tables by column name; a column absent from one is null there."""
    out = None
    for name, df in tables.items():
        if tag is not None:
            df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
