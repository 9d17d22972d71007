"""Ordered scans that stay distributed when one group is very large.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key into one task.
Everything here has a second form: the key is cut into ordered chunks, each
chunk is scanned on its own, and the chunks' totals (one small row each) carry
the running state across. The big side is shuffled once, by ``(key, chunk)``.
Which form runs is decided by counting: only keys and time axes that are too
large for one task are cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import wall_micros

#: A counted table up to this many bytes is broadcast; beyond it the join is left
#: to Spark (sort-merge with adaptive skew handling).
BROADCAST_BYTES = 64 * 1024 * 1024

#: Distinct times per scan chunk; above this a time axis is cut into chunks.
TIMES_PER_CHUNK = 50_000

#: Keys with more rows than this are scanned in chunks.
ROWS_PER_KEY = 1_000_000


# --- chunk keys ------------------------------------------------------------


def day_chunk(col: str, days: int = 365) -> Column:
    """Chunk key of a date or timestamp column: ``days``-wide pieces of the calendar."""
    return F.floor(F.unix_date(F.to_date(col)) / F.lit(days)).cast("int")


def hour_chunk(col: str, hours: int = 1) -> Column:
    """Chunk key of a timestamp column, for keys with very many rows per day."""
    return F.floor((F.unix_date(F.to_date(col)) * 24 + F.hour(col)) / F.lit(hours)).cast("long")


def chunk_hot_keys(df: DataFrame, id: str, chunk: Column) -> DataFrame | None:
    """``df`` with ``_chunk`` set for the keys that hold too many rows for one task.

    Only those keys pay for chunks; null elsewhere. Rows of such a key whose chunk
    is null (a null order value) go to a chunk before all others, where a plain
    window has them too. None when there is no such key, so that a plain window
    does. One counting pass over the key column.
    """
    hot = (df.where(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_PER_KEY)
           .select(F.col(id).alias("_hot"), F.lit(True).alias("_is_hot"))).persist()
    n = hot.count()
    if n == 0:
        hot.unpersist()
        return None
    side = F.broadcast(hot) if fits_broadcast(n, 2) else hot
    return (df.join(side, df[id] == side["_hot"], "left")
            .withColumn("_chunk", F.when(F.col("_is_hot"), F.coalesce(chunk, F.lit(-(1 << 31))))).drop("_hot", "_is_hot"))


def fits_broadcast(rows: int, columns: int) -> bool:
    """Is a table with this counted number of rows small enough to send to every task?"""
    return rows * columns * 8 <= BROADCAST_BYTES


def axis_number(df: DataFrame, col: str) -> Column:
    """A time column as a number that orders alike: days of a date, microseconds of a timestamp."""
    kind = df.schema[col].dataType.typeName()
    if kind == "date":
        return F.unix_date(col)
    if kind == "timestamp":
        return F.unix_micros(col)
    return wall_micros(col) if kind == "timestamp_ntz" else F.col(col)


def time_splits(df: DataFrame, col: str, per_chunk: int = TIMES_PER_CHUNK) -> list:
    """Cut points that balance the distinct values of ``col``, empty when few; as :func:`axis_number` has them.

    One aggregate over one pruned column; the number of cuts grows with the number of
    values. The approximate quantiles only choose where to cut, so results
    stay exact whatever they are.
    """
    values = df.select(axis_number(df, col).alias("_v")).distinct()
    n = values.agg(F.count("_v")).first()[0]
    chunks = -(-n // per_chunk)
    if chunks <= 1:
        return []
    at = [i / chunks for i in range(1, chunks)]
    return sorted(set(values.agg(F.percentile_approx("_v", at, max(10_000, 10 * chunks))).first()[0]))


def split_chunk(df: DataFrame, col: str, splits: Sequence, out: str = "_chunk") -> DataFrame:
    """Add the index of the piece that holds the column: cut points at or below it."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    edges = [float("-inf"), *sorted({_axis_value(s) for s in splits}), float("inf")]
    cut = Bucketizer(splits=edges, inputCol="_at", outputCol="_piece")      # binary search per row
    return cut.transform(df.withColumn("_at", axis_number(df, col).cast("double"))).withColumn(
        out, F.col("_piece").cast("int")).drop("_at", "_piece")


def _axis_value(cut) -> float:
    """A cut point as a number; dates and (UTC) datetimes are taken too."""
    if isinstance(cut, datetime):
        return (cut.replace(tzinfo=None) - datetime(1970, 1, 1)) / timedelta(microseconds=1)
    return float((cut - date(1970, 1, 1)).days) if isinstance(cut, date) else float(cut)


# --- running totals --------------------------------------------------------


def running(df: DataFrame, by: Sequence[str], order: str,
            outputs: Mapping[str, tuple], splits: Sequence = (), keep_chunk: bool = False) -> DataFrame:
    """Running sums and products along ``order`` (unique within ``by``).

    ``outputs`` maps a new column to ``(kind, column)``; kinds are ``sum``,
    ``product``, ``sum_before`` / ``product_before`` (strictly earlier rows),
    ``sum_from`` (this row and all later ones) and ``sum_after`` (later rows only).

    ``keep_chunk`` leaves the chunk column in; a later scan of the result uses it
    and finds the rows already partitioned.
    """
    if not splits:
        return _scan_all(df, by, order, outputs)

    keys = [*by, "_chunk"]
    chunked = df if "_chunk" in df.columns else split_chunk(df, order, splits)
    local = _scan_all(chunked, keys, order, outputs)
    totals = chunked.groupBy(*keys).agg(*[
        (F.product(F.col(col)) if kind.startswith("product") else F.sum(col)).alias(f"_t_{out}")
        for out, (kind, col) in outputs.items()])
    carry = _scan_all(totals, by, "_chunk", {
        f"_c_{out}": (_carry_kind(kind), f"_t_{out}") for out, (kind, _) in outputs.items()})
    carry = carry.select(*keys, *[f"_c_{out}" for out in outputs])
    done = local.join(carry, keys)
    done = done.withColumns({
        out: (F.col(out) * F.col(f"_c_{out}") if kind.startswith("product")
              else F.col(out) + F.col(f"_c_{out}"))
        for out, (kind, _) in outputs.items()})
    done = done.select(*chunked.columns, *outputs)
    return done if keep_chunk else done.drop("_chunk")


def _scan_all(df, by, order, outputs):
    # sums as SQL text: one call each, however many columns a model has
    sums = [f"coalesce(sum(`{col}`) OVER ({_frame_sql(kind, by, order)}), 0) AS `{out}`"
            for out, (kind, col) in outputs.items() if kind.startswith("sum")]
    df = df.selectExpr("*", *sums) if sums else df
    products = {out: (kind, col) for out, (kind, col) in outputs.items() if kind.startswith("product")}
    return df.withColumns({
        out: F.coalesce(F.product(F.col(col)).over(_frame(kind, by, order)), F.lit(1.0))
        for out, (kind, col) in products.items()}) if products else df


def _carry_kind(kind: str) -> str:
    if kind in ("sum_from", "sum_after"):
        return "sum_after"
    return kind.split("_")[0] + "_before"


def _frame_sql(kind: str, by: Sequence[str], order: str) -> str:
    part = f"PARTITION BY {', '.join(f'`{c}`' for c in by)} " if by else ""
    back = " DESC" if kind in ("sum_from", "sum_after") else ""
    last = "1 PRECEDING" if kind.endswith(("_before", "_after")) else "CURRENT ROW"
    return f"{part}ORDER BY `{order}`{back} ROWS BETWEEN UNBOUNDED PRECEDING AND {last}"


def _frame(kind: str, by: Sequence[str], order: str):
    last = -1 if kind.endswith("_before") else Window.currentRow
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, last)


# --- neighbours and carry-forward -----------------------------------------


def next_value(df: DataFrame, id: str, order: Sequence[str], outputs: Mapping[str, str],
               chunk: Column | None = None) -> DataFrame:
    """Values of the following row per ``id``: ``{new column: source column}``."""
    return adjacent_values(df, id, order, after=outputs, chunk=chunk)


def previous_value(df: DataFrame, id: str, order: Sequence[str], outputs: Mapping[str, str],
                   chunk: Column | None = None) -> DataFrame:
    """Values of the preceding row per ``id``."""
    return adjacent_values(df, id, order, before=outputs, chunk=chunk)


def adjacent_values(df: DataFrame, id: str, order: Sequence[str], before: Mapping[str, str] = {},
                    after: Mapping[str, str] = {}, chunk: Column | None = None) -> DataFrame:
    """Values of the preceding and of the following row per ``id``, in one scan."""
    def moved(w):
        return {**{out: F.lag(c).over(w) for out, c in before.items()},
                **{out: F.lead(c).over(w) for out, c in after.items()}}

    chunked = None if chunk is None else chunk_hot_keys(df, id, chunk)
    if chunked is None:
        return df.withColumns(moved(Window.partitionBy(id).orderBy(*order)))

    w = Window.partitionBy(id, "_chunk").orderBy(*order)
    local = chunked.withColumns({
        **moved(w), "_first": F.lag(F.lit(1)).over(w).isNull(), "_last": F.lead(F.lit(1)).over(w).isNull()})

    def pack(outputs):
        return F.struct(F.lit(1).alias("_one"), *[F.col(c).alias(out) for out, c in outputs.items()])

    key, along = F.struct(*order), Window.partitionBy(id).orderBy("_chunk")
    ends = chunked.where(F.col("_chunk").isNotNull()).groupBy(id, "_chunk").agg(
        F.max_by(pack(before), key).alias("_tail"), F.min_by(pack(after), key).alias("_head"))
    ends = ends.select(id, "_chunk", F.lag("_tail").over(along).alias("_before"),
                       F.lead("_head").over(along).alias("_after"))
    # keys without chunks find nothing here and keep their own values
    done = local.join(ends, [id, "_chunk"], "left")
    return done.withColumns({
        **{o: F.when(F.col("_first"), F.col(f"_before.{o}")).otherwise(F.col(o)) for o in before},
        **{o: F.when(F.col("_last"), F.col(f"_after.{o}")).otherwise(F.col(o)) for o in after},
    }).select(*df.columns, *before, *after)


def carry_forward(df: DataFrame, id: str, order: Sequence[str], cols: Sequence[str],
                  chunk: Column | None = None) -> DataFrame:
    """Last non-null value so far per ``id``, for each of ``cols``."""
    def carried(w):
        w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return {c: F.last(c, ignorenulls=True).over(w) for c in cols}

    chunked = None if chunk is None else chunk_hot_keys(df, id, chunk)
    if chunked is None:
        return df.withColumns(carried(Window.partitionBy(id)))

    local = chunked.withColumns(carried(Window.partitionBy(id, "_chunk")))
    key = F.struct(*order)
    ends = chunked.where(F.col("_chunk").isNotNull()).groupBy(id, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_end_{c}") for c in cols])
    earlier = Window.partitionBy(id).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(id, "_chunk", *[
        F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_end_{c}") for c in cols])
    done = local.join(ends, [id, "_chunk"], "left")
    return done.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_end_{c}")) for c in cols}).select(*df.columns)


# --- tied events -----------------------------------------------------------

NEAR_TIES = 256        # the last tied events of a time, added up one by one; so are all of twice that
_TIE_SUMS = {
    "b0": "1 / x.q", "b1": "x.c / x.q", "a0": "1 / (x.q * x.q)", "a1": "x.c / (x.q * x.q)",
    "a2": "x.c * x.c / (x.q * x.q)", "lq": "ln(x.q)",
}
# derivative of each with respect to l, times m: dq/dl = -e0 / m
_TIE_SLOPES = {
    "b0": "{e} / (x.q * x.q)", "b1": "1 / x.q + x.c * {e} / (x.q * x.q)",
    "a0": "2 * {e} / (x.q * x.q * x.q)", "a1": "1 / (x.q * x.q) + 2 * x.c * {e} / (x.q * x.q * x.q)",
    "a2": "2 * x.c / (x.q * x.q) + 2 * x.c * x.c * {e} / (x.q * x.q * x.q)", "lq": "-{e} / x.q",
}
_GAUSS = [(float(x), float(w)) for x, w in zip(*np.polynomial.legendre.leggauss(10))]


def tie_sums(df: DataFrame, m: str, s0: str, e0: str) -> DataFrame:
    """Sums over the ``m`` tied events of a time, with ``q_l = s0 - (l/m)·e0`` and ``c = l/m``.

    Adds ``b0, b1`` (sums of ``c^k/q``), ``a0, a1, a2`` (sums of ``c^k/q²``) and
    ``lq`` (sum of ``ln q``); 0 where nothing is tied. The work of a time is bounded
    however many events it has: the last 256, where ``q`` may come close to
    0, are added up one by one, and the sum over all earlier ones is the integral
    from half a step before the first to half a step after the last, less 1/24 of the
    difference of the slopes there (Euler and Maclaurin; what follows is below
    1e-12 of the sum). The integral is taken by Gauss' rule on panels over which the
    distance to the root of ``q`` doubles, so differences of digamma
    values, which cancel when few of those at risk have an event, are never formed.
    """
    far, left, right = f"({m} - {NEAR_TIES})", "-0.5D", f"({m} - {NEAR_TIES} - 0.5D)"
    root = f"(try_divide({s0} * {m}, {e0}))"            # q is 0 there; null when all q are the same
    gap = f"({root} - {right})"
    panels = f"coalesce(cast(greatest(1D, ceil(log2(try_divide({root} + 0.5D, {gap})))) AS int), 1)"
    nodes = ", ".join(f"named_struct('x', {x!r}D, 'w', {w!r}D)" for x, w in _GAUSS)

    def at(l: str, w: str) -> str:
        return f"named_struct('c', ({l}) / {m}, 'q', {s0} - ({l}) / {m} * {e0}, 'w', {w})"

    first = f"if({m} <= {2 * NEAR_TIES}, 0L, cast({far} AS bigint))"
    near = f"transform(sequence({first}, cast({m} AS bigint) - 1), l -> {at('l', '1D')})"
    edges = (f"transform(sequence(0, {panels} - 1), i -> named_struct("
             f"'hi', if(i = 0, {right}, {root} - {gap} * pow(2D, i)), "
             f"'lo', if(i = {panels} - 1, {left}, {root} - {gap} * pow(2D, i + 1))))")
    inner = at("(p.hi + p.lo) / 2 + g.x * (p.hi - p.lo) / 2", "g.w * (p.hi - p.lo) / 2")
    rest = f"flatten(transform({edges}, p -> transform(array({nodes}), g -> {inner})))"
    points = f"if({m} <= {2 * NEAR_TIES}, {near}, concat({near}, {rest}))"
    zero = ", ".join(f"'{k}', 0D" for k in _TIE_SUMS)
    add = ", ".join(f"'{k}', z.{k} + x.w * ({v})" for k, v in _TIE_SUMS.items())
    df = df.selectExpr("*", f"if({m} > 0, aggregate({points}, named_struct({zero}), (z, x) -> named_struct({add})), NULL) AS _tied",
                       f"if({m} > {2 * NEAR_TIES}, array({at(right, '1D')}, {at(left, '-1D')}), NULL) AS _ends")

    def bend(k: str) -> str:
        slope = _TIE_SLOPES[k].format(e=f"{e0}")
        return f"coalesce(aggregate(_ends, 0D, (z, x) -> z + x.w * ({slope})) / (24 * {m}), 0D)"
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in ("_tied", "_ends")],
                         *[f"coalesce(_tied.{k}, 0D) - if({m} > 0, {bend(k)}, 0D) AS {k}" for k in _TIE_SUMS])
