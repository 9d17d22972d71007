"""Frequency tables, descriptives and daily summaries."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .longitudinal import last_per_group
from .reshape import gather
from ..sources.io import materialize


def freq(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value; null is a value of its own."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def freq_percent(df: DataFrame, *cols: str, digits: int = 2) -> DataFrame:
    """Rows and share of all rows per value.

    The total is a scalar subquery over the aggregated rows, not a second scan
    and not a window that would gather every value in one task.
    """
    counts = freq(df, *cols)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.bround(F.col("n") / total * 100, digits))


def missing_profile(df: DataFrame, cols: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Share of nulls per column: one pass, one row, then unpivoted."""
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * scale).alias(c) for c in cols])
    return one.unpivot([], list(cols), "variable", "missing")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_ACCURACY = 10_000
FEW = 2_000      # a range with at most this many values is listed, value by value


class _Rank:
    """Order statistic number ``rank`` (from 0) of a column: it lies strictly between ``low`` and ``high``.

    ``before`` values are at or below ``low`` and ``count`` inside the range; both are counted exactly.
    """

    def __init__(self, col: str, rank: int, count: int):
        self.col, self.rank, self.before, self.count = col, rank, 0, count
        self.low = self.high = self.value = None

    def inside(self, low, high):
        v, bounds = F.col(self.col), F.col(self.col).isNotNull()
        bounds = bounds if low is None else bounds & (v > F.lit(low))
        return bounds if high is None else bounds & (v < F.lit(high))

    def shares(self) -> list[float]:
        """The rank's place among the values of the range, less and more the error of a sketch twice over."""
        at, slack = (self.rank - self.before + 0.5) / self.count, 2.0 / _ACCURACY
        return [min(max(at + s, 0.0), 1.0) for s in (-slack, slack)]

    def cells(self, low, high) -> list[Column]:
        """Counts below, at and between the edges and at the high one, inside the range."""
        v, live = F.col(self.col), self.inside(self.low, self.high)
        return [F.count_if(live & (v < F.lit(low))), F.count_if(live & (v == F.lit(low))), F.count_if(self.inside(low, high)),
                F.count_if(live & (v == F.lit(high)) & (F.lit(low) != F.lit(high)))]

    def narrow(self, low, high, counts) -> None:
        """Go on in the cell that holds the rank, whichever it is: approximate edges need not enclose it."""
        cells = ((self.low, low, None), (low, low, low), (low, high, None), (high, high, high), (high, self.high, None))
        for (a, z, value), count in zip(cells, [*counts, self.count - sum(counts)]):
            if self.rank < self.before + count:
                self.low, self.high, self.count, self.value = a, z, count, value
                return
            self.before += count
        raise AssertionError(f"rank {self.rank} of {self.col} is not among the counted values")


def order_statistics(df: DataFrame, ranks: Mapping[str, Sequence[int]], counts: Mapping[str, int]) -> dict:
    """``{(column, rank): value}``: the exact values at these ranks (from 0) of the sorted non-null values.

    All are selected together by refining ranges. A round takes approximate quantiles on both sides of every
    wanted rank, one sketch a range, and then counts exactly how many values lie below, at, between and above
    them; the rank's cell is the next range, one in thousands of the last. Ties end a search at once, and the
    ``FEW`` values of a last range are counted one by one. A round sends the driver one row.
    """
    wanted = [_Rank(c, r, counts[c]) for c, rs in ranks.items() for r in sorted(set(rs))]
    while todo := [w for w in wanted if w.value is None and w.count > FEW]:
        ranges = {}
        for w in todo:
            ranges.setdefault((w.col, w.low, w.high), []).append(w)
        found = df.agg(*[F.percentile_approx(
            F.when(ws[0].inside(ws[0].low, ws[0].high), F.col(ws[0].col)), [s for w in ws for s in w.shares()], _ACCURACY)
            for ws in ranges.values()]).first()
        edges = {w: (e[2 * i], e[2 * i + 1]) for ws, e in zip(ranges.values(), found) for i, w in enumerate(ws)}
        cells = df.agg(*[c for w in todo for c in w.cells(*edges[w])]).first()
        for i, w in enumerate(todo):
            w.narrow(*edges[w], cells[4 * i:4 * i + 4])
    last = [w for w in wanted if w.value is None]
    if last:
        listed = df.select(F.explode(F.array_compact(F.array(*[
            F.when(w.inside(w.low, w.high), F.struct(F.lit(i).alias("i"), F.col(w.col).alias("v"))) for i, w in enumerate(last)]))).alias("_v"))
        values = {}
        for i, v, n in listed.groupBy("_v.i", "_v.v").agg(F.count(F.lit(1))).collect():     # at most FEW a rank
            values.setdefault(i, []).append((v, n))
        for i, w in enumerate(last):
            for v, n in sorted(values[i], key=lambda x: (x[0] != x[0], x[0])):       # NaN is the largest, as in Spark
                w.value, w.before = v, w.before + n
                if w.rank < w.before:
                    break
    return {(w.col, w.rank): w.value for w in wanted}


def describe_continuous(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per variable: % missing, mean, sd, min, quartiles, max; no row for an empty table.

    Quartiles are exact, interpolated between order statistics (:func:`order_statistics`).
    The columns are read once from ``df`` and kept for the passes; the driver gets one row a pass.
    """
    values, release = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    try:
        one = values.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (
            ("k", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]).first()
        counts = {c: one[f"k_{c}"] for c in cols}
        place = {(c, q): (counts[c] - 1) * p for c in cols if counts[c] for q, p in QUARTILES.items()}
        ranks = {c: [r for q in QUARTILES for r in (math.floor(place[c, q]), math.ceil(place[c, q]))] for c in cols if counts[c]}
        at = order_statistics(values, ranks, counts)
    finally:
        release()

    def quartile(c, q):
        if (c, q) not in place:
            return None
        h = place[c, q]
        low, high = at[c, math.floor(h)], at[c, math.ceil(h)]
        return low if low == high else low + (high - low) * (h - math.floor(h))

    rows = [(c, (1 - counts[c] / one["_n"]) * 100, one[f"mean_{c}"], one[f"sd_{c}"], one[f"min_{c}"],
             *[quartile(c, q) for q in QUARTILES], one[f"max_{c}"]) for c in cols if one["_n"]]
    names = ["missing_pct", "mean", "sd", "min", *QUARTILES, "max"]
    return df.sparkSession.createDataFrame(rows, f"variable string, {', '.join(f'{n} double' for n in names)}")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per 0/1 variable: % yes of *all* rows, % missing. One row of sums, then unpivoted; no row for an empty table."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[s for c in cols for s in (
        F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"_yes_{c}"), F.count(c).alias(f"_known_{c}"))])
    return one.where(F.col("_n") > 0).select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("variable"), (F.col(f"_yes_{c}") / F.col("_n") * 100).alias("yes_pct"),
        ((1 - F.col(f"_known_{c}") / F.col("_n")) * 100).alias("missing_pct")) for c in cols])).alias("_v")).select("_v.*")


# --- by day ----------------------------------------------------------------


def _daily(df: DataFrame, cols: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals open per ``(day, variable)``: ``yes``, ``known`` and ``n``.

    Equals a count over one row per interval and day, without building those
    rows: an interval adds at ``start`` and removes at ``end``; the changes are
    combined before the shuffle and summed along the days. Only then is the
    short step function filled out to every day.
    """
    live = df.where(F.col(start) < F.col(end)).select(
        F.explode(F.array(
            F.struct(F.col(start).cast("int").alias("day"), F.lit(1).alias("sign")),
            F.struct(F.col(end).cast("int").alias("day"), F.lit(-1).alias("sign")),
        )).alias("_e"), *cols)
    change = live.groupBy("_e.day").agg(
        F.sum("_e.sign").alias("_n"),
        *[F.sum(F.col("_e.sign") * F.col(c)).alias(f"_yes_{c}") for c in cols],
        *[F.sum(F.when(F.col(c).isNotNull(), F.col("_e.sign"))).alias(f"_known_{c}") for c in cols])
    rows = change.select("day", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col("_n").alias("n"),
                 F.coalesce(F.col(f"_yes_{c}"), F.lit(0)).alias("yes"),
                 F.coalesce(F.col(f"_known_{c}"), F.lit(0)).alias("known"))
        for c in cols])).alias("_v")).select("day", "_v.*")
    w = Window.partitionBy("variable").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = rows.select(
        "variable", "day", F.lead("day").over(w).alias("_until"),
        F.sum("n").over(upto).alias("n"), F.sum("yes").over(upto).alias("yes"),
        F.sum("known").over(upto).alias("known")).where(F.col("n") > 0)
    return steps.select("variable", F.explode(F.sequence("day", F.col("_until") - 1)).alias("day"),
                        "n", "yes", "known")


def daily_prevalence(df: DataFrame, cols: Sequence[str], start: str = "start_time",
                     end: str = "end_time") -> DataFrame:
    """% yes per day and 0/1 variable over the intervals open that day, nulls left out."""
    d = _daily(df, cols, start, end)
    return d.select("day", "variable", F.when(F.col("known") > 0, F.col("yes") / F.col("known") * 100)
                    .alias("yes_pct"))


def daily_counts(df: DataFrame, cols: Sequence[str], start: str = "start_time",
                 end: str = "end_time") -> DataFrame:
    """Open intervals per day, variable and category (``Yes``, ``No``, null)."""
    d = _daily(df, cols, start, end)
    return d.select("day", "variable", F.explode(F.array(
        F.struct(F.lit("Yes").alias("category"), F.col("yes").alias("n")),
        F.struct(F.lit("No").alias("category"), (F.col("known") - F.col("yes")).alias("n")),
        F.struct(F.lit(None).cast("string").alias("category"), (F.col("n") - F.col("known")).alias("n")),
    )).alias("_c")).select("day", "variable", "_c.*").where(F.col("n") > 0)


def longitudinal_points(cp: DataFrame, id: str, cols: Sequence[str], start: str = "start_time",
                        final: str = "time") -> DataFrame:
    """``(id, time, variable, value)`` at every visit, plus the last value at the final time."""
    values = [F.col(c).cast("double").alias(c) for c in cols]
    at_visit = gather(cp.select(id, F.col(start).alias("time"), *values), cols)
    last = last_per_group(cp, id, [start])
    closing = gather(last.select(id, F.col(final).alias("time"), *values), cols)
    return at_visit.unionByName(closing)
