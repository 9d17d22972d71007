"""Match-merges, neighbour look-ups, interval joins and as-of cuts.

No join here carries a broadcast hint: every side may grow with the data, so
the choice is left to Catalyst's size estimate and to adaptive execution, which
also splits a hot key of a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_set
from .scan import chunk_hot_keys, next_value


#: A span of at most so many time bins is dealt over them as it is.
NEAR_BINS = 64


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per duplicated key; empty when ``keys`` identify a row."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """``df``, raising in the same job when a key occurs twice (rows with a null key are not looked at).

    The check is a one-row look back along the sorted keys. A merge on the same keys
    uses the partitioning and the order it leaves; a repeated key raises at its
    second row, whatever the number of its rows.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    again = F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*keys)).isNotNull()
    told = F.concat_ws(", ", F.lit(f"{what}: key ({', '.join(keys)}) occurs twice"), *[F.col(k).cast("string") for k in keys])
    return df.withColumn("_again", known & again).where(
        F.when(F.col("_again"), F.raise_error(told).cast("boolean")).otherwise(True)).drop("_again")


def merge_full(a: DataFrame, b: DataFrame, on: Sequence[str], unique: bool = False) -> DataFrame:
    """Full match-merge on unique keys.

    For a column present on both sides the right table wins wherever it has a
    row, even if its value is missing. ``unique=True`` raises when a key occurs twice
    on either side.
    """
    on = list(on)
    if unique:
        a, b = assert_unique(a, on, "left table"), assert_unique(b, on, "right table")
    shared = [c for c in b.columns if c in a.columns and c not in on]
    right = b.select(*on, F.lit(True).alias("_right"),
                     *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c)
                       for c in b.columns if c not in on])
    joined = a.join(right, on, "full")
    joined = joined.withColumns(
        {c: F.when(F.col("_right"), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in shared})
    new = [c for c in b.columns if c not in a.columns]
    return joined.select(*a.columns, *new)


def merge_left(a: DataFrame, b: DataFrame, on: Sequence[str],
               cols: Sequence[str] | None = None, unique: bool = False) -> DataFrame:
    """Keep every row of ``a``; take ``cols`` (default: all new ones) from ``b``.

    ``unique=True`` raises when a key of ``b`` occurs twice, which would repeat rows of ``a``.
    """
    on = list(on)
    if unique:
        b = assert_unique(b, on, "right table")
    if cols is None:
        cols = [c for c in b.columns if c not in a.columns]
    return a.join(b.select(*on, *cols), on, "left").select(*a.columns, *cols)


def merge_left_many(df: DataFrame, others: Sequence[tuple]) -> DataFrame:
    """Fold of left merges; each entry is ``(table, keys, columns)``.

    Consecutive merges on the same keys reuse one partitioning of ``df``.
    """
    for other, on, cols in others:
        df = merge_left(df, other, on, cols)
    return df


def lookup_neighbor(df: DataFrame, other: DataFrame, id: str, neighbor: str,
                    visit: str, cols: Sequence[str], prefix: str, unique: bool = False) -> DataFrame:
    """Fetch ``cols`` of the visit named in column ``neighbor`` as ``prefix + col``.

    ``unique=True`` raises when ``other`` has two rows of one visit.
    """
    if unique:
        other = assert_unique(other, [id, visit], "visits")
    side = other.select(F.col(id), F.col(visit).alias(neighbor),
                        *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(side, [id, neighbor], "left").select(*df.columns, *[prefix + c for c in cols])


def interval_join(points: DataFrame, spans: DataFrame, id: str, at: str, start: str,
                  end: str, open_end: str = "drop", width: int = 30) -> DataFrame:
    """Pairs with the same ``id`` and ``start <= at <= end`` (dates).

    A missing start is below every date, so it always passes the lower bound. A
    missing end never matches (``open_end='drop'``) or always does (``'keep'``).

    Both sides are cut into time bins of ``width`` days and joined on
    ``(id, bin)``: rows far apart in time never meet, and a hot ``id`` spreads
    over as many keys as it has bins. A point goes to its bin and to the one before,
    so a span goes to every second of its bins only, and each pair still meets once.
    A span with an open side, or one of very many bins, is clipped to the
    subject's first and last point, so its bins stay finite; the others need no
    look at the points.
    """
    if open_end not in ("drop", "keep"):
        raise ValueError("open_end must be 'drop' or 'keep'")
    live = points.where(F.col(at).isNotNull())
    if open_end == "drop":
        spans = spans.where(F.col(end).isNotNull())
    first, last = F.col(start), F.col(end)
    # null with an open side
    near = F.coalesce(_bin(last, width) - _bin(first, width) <= NEAR_BINS, F.lit(False))
    bounds = live.groupBy(id).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    low, high = F.col("_lo"), F.col("_hi")
    far = deal_spans(spans.where(~near).join(bounds, id), F.greatest(F.coalesce(first, low), low), F.least(F.coalesce(last, high), high), width)
    right = deal_spans(spans.where(near), first, last, width).unionByName(far.drop("_lo", "_hi"))
    own = _bin(F.col(at), width)
    left = live.withColumn("_bin", F.explode(F.array(own, own - 1)))
    hits = left.join(right, [id, "_bin"]).where(
        F.coalesce(first <= F.col(at), F.lit(True)) & F.coalesce(F.col(at) <= last, F.lit(True)))
    return hits.select(id, *[c for c in points.columns if c != id],
                       *[c for c in spans.columns if c != id])


def deal_spans(spans: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """A row for every second time bin (``_bin``) from ``low`` to ``high``: it stands for that bin and the next."""
    return spans.where(low <= high).withColumn("_bin", F.explode(F.sequence(_bin(low, width), _bin(high, width), F.lit(2))))


def _bin(date: Column, width: int) -> Column:
    return F.floor(F.unix_date(date) / F.lit(width)).cast("int")


def asof_join(df: DataFrame, grid: Sequence[int], id: str, rtime: str,
              closed: str = "left", out: str = "LM", chunk: Column | None = None,
              ties: Sequence[str] = ()) -> DataFrame:
    """For every grid time the last row per subject before it.

    Of rows at one time the last in the order of ``ties`` is taken. ``closed='left'`` takes rows strictly before the grid time, ``'right'``
    also a row exactly on it. Instead of pairing rows with the grid and ranking,
    each row finds how long it stays the latest one (time of the next row) and
    emits only the grid times in that stretch.
    """
    if closed not in ("left", "right"):
        raise ValueError("closed must be 'left' or 'right'")
    nxt = next_value(df, id, [rtime, *ties], {"_next": rtime}, chunk)
    times = F.array(*[F.lit(g) for g in sorted(grid)])
    if closed == "left":
        covers = lambda g: (g > F.col(rtime)) & (F.col("_next").isNull() | (g <= F.col("_next")))
    else:
        covers = lambda g: (g >= F.col(rtime)) & (F.col("_next").isNull() | (g < F.col("_next")))
    return nxt.select(F.explode(F.filter(times, covers)).alias(out), *df.columns)


def first_match_visit(df: DataFrame, onset: str, calendar: dict[str, str],
                      out: str = "visit", offsets: dict[str, str] | None = None) -> DataFrame:
    """First visit, in protocol order, that is dated on or after ``onset``.

    ``calendar`` maps a visit code to the column with its date; its order is the
    protocol order, which wins over date order. ``offsets`` maps a new column to
    a date column and yields the days from that date to the matched visit.
    """
    hits = {code: F.col(onset) <= F.col(c) for code, c in calendar.items()}
    matched = F.coalesce(*[F.when(hits[code], F.col(c)) for code, c in calendar.items()])
    done = df.withColumn(out, first_set(hits)).withColumn("_matched", matched)
    for name, source in (offsets or {}).items():
        done = done.withColumn(name, F.datediff(F.col("_matched"), F.col(source)))
    return done.drop("_matched")


def first_match_rows(df: DataFrame, calendar: DataFrame, id: str, onset: str, date: str, rank: str, visit: str,
                     out: str = "visit", matched: str = "matched", chunk: Callable[[str], Column] | None = None) -> DataFrame:
    """First visit, by protocol ``rank``, that is dated on or after ``onset``, from a calendar kept as rows.

    ``calendar`` has one row per visit of a subject: any number of them. Onsets are
    not paired with visits: both are laid on one axis per subject, and from its end
    a running minimum of the rank says at every onset which visit comes first.
    ``chunk`` makes an ordered chunk key of a column (:func:`.scan.day_chunk`); subjects with very many
    rows are then scanned in chunks. Adds ``out`` and its date ``matched``, null where
    nothing matches, the onset or the subject is null. Equal ranks go by visit.
    """
    best = F.struct(F.col(rank).alias("rank"), F.col(visit).alias("visit"), F.col(date).alias("date"))
    visits = calendar.where(F.col(date).isNotNull() & F.col(rank).isNotNull()).select(
        F.col(id).alias("_id"), F.col(date).alias("_at"), F.lit(0).alias("_kind"), best.alias("_best"),
        F.lit(None).cast(df.schema).alias("_row"))
    asked = df.select(F.col(id).alias("_id"), F.col(onset).cast(calendar.schema[date].dataType).alias("_at"), F.lit(1).alias("_kind"),
                      F.lit(None).cast(visits.schema["_best"].dataType).alias("_best"), F.struct(*df.columns).alias("_row"))
    axis = visits.unionByName(asked)

    def scanned(rows, *keys):
        w = Window.partitionBy("_id", *keys).orderBy(F.desc("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_found", F.min("_best").over(w))

    chunked = None if chunk is None else chunk_hot_keys(axis, "_id", chunk("_at"))
    if chunked is None:
        done = scanned(axis)
    else:
        later = Window.partitionBy("_id").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        ends = chunked.where(F.col("_chunk").isNotNull()).groupBy("_id", "_chunk").agg(F.min("_best").alias("_end"))
        ends = ends.select("_id", "_chunk", F.min("_end").over(later).alias("_later"))
        done = scanned(chunked, "_chunk").join(ends, ["_id", "_chunk"], "left").withColumn("_found", F.least("_found", "_later"))
    valid = F.col("_id").isNotNull() & F.col("_at").isNotNull()
    return done.where("_kind = 1").select("_row.*", F.when(valid, F.col("_found.visit")).alias(out),
                                          F.when(valid, F.col("_found.date")).alias(matched))


def treatment_onsets(spans: DataFrame, calendar: DataFrame, id: str, start: str, end: str, date: str, rank: str,
                     visit: str, flag: str | None = None, chunk: Callable[[str], Column] | None = None) -> DataFrame:
    """At which visit did a treatment begin? ``(id, rule, visit, days_from_start, days_from_end)``.

    Rule ``onset``: every span with a start belongs to the first visit, by protocol ``rank``, dated on or
    after it (none: null); an open end counts as its start, and the days run from start and end to the
    visit. Rule ``flag``: the first visit by protocol whose ``flag`` is true, one row per subject, no days.
    """
    begun = spans.where(F.col(start).isNotNull()).select(
        id, F.col(start).alias("_start"), F.coalesce(F.col(end), F.col(start)).alias("_end"))
    found = first_match_rows(begun, calendar, id, "_start", date, rank, visit, "_visit", "_matched", chunk)
    found = found.select(id, F.lit("onset").alias("rule"), F.col("_visit").alias("visit"),
                         F.datediff("_matched", "_start").alias("days_from_start"),
                         F.datediff("_matched", "_end").alias("days_from_end"))
    if flag is None:
        return found
    # a combining aggregate: a subject with very many flagged visits sends one row per map task
    flagged = calendar.where(F.col(flag) & F.col(id).isNotNull()).groupBy(id).agg(
        F.min(F.struct(rank, visit)).alias("_v")).select(
            id, F.lit("flag").alias("rule"), F.col(f"_v.{visit}").alias("visit"),
            F.lit(None).cast("int").alias("days_from_start"), F.lit(None).cast("int").alias("days_from_end"))
    return found.unionByName(flagged)
