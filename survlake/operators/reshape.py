"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import chunk_hot_keys


def gather(df: DataFrame, cols: Sequence[str], key: str = "variable", value: str = "value") -> DataFrame:
    """Columns to ``(key, value)`` rows; every other column is repeated."""
    keep = [c for c in df.columns if c not in cols]
    return df.unpivot(keep, list(cols), key, value)


# name patterns: group 1 is the measure, group 2 the visit
FIRST_TOKEN = r"^([^_]+)_([^_]+)"     # measure before the first "_", visit is the next token
LAST_TOKEN = r"^(.*)_([^_]+)$"        # visit after the last "_"


def wide_to_long(df: DataFrame, id: Sequence[str], cols: Sequence[str],
                 pattern: str = LAST_TOKEN, measure: str = "variable",
                 visit: str = "visit", value: str = "value") -> DataFrame:
    """``measure_visit`` columns to rows ``(id, measure, visit, value)``.

    Each row gives its own rows, so they stay dealt by ``id`` where ``df`` was (an
    unpivot forgets that); the names are taken apart once, not in every row.
    """
    kind = df.select(*id, *cols).unpivot(list(id), list(cols), "_name", value).schema[value].dataType
    return df.select(*id, F.inline(F.array(*[
        F.struct(F.regexp_extract(F.lit(c), pattern, 1).alias(measure), F.regexp_extract(F.lit(c), pattern, 2).alias(visit),
                 F.col(c).cast(kind).alias(value)) for c in cols])))


def long_to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str,
                 names: Sequence[str]) -> DataFrame:
    """One row per key, one column per listed name.

    The names are given, so Spark needs no extra pass to discover them: one hash
    aggregate with a column for each, which combines before the shuffle and needs
    none where the rows lie by some of the keys already. A pivot would first group
    by the keys and the name, so hold and shuffle a row for each single value.
    ``(keys, name)`` should be unique; the largest value wins where it is not.
    """
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(name).eqNullSafe(F.lit(n)), F.col(value))).alias(str(n)) for n in names])


def visit_sequence(df: DataFrame, id: str, order: Sequence[str], visit: str, n: int,
                   prefix: str = "v") -> DataFrame:
    """The first ``n`` visits of each subject as columns ``v1 … vn``.

    Ranks are limited before the shuffle, so a subject sends at most ``n`` rows
    per map task.
    """
    w = Window.partitionBy(id).orderBy(*order)
    top = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    wide = top.groupBy(id).pivot("_k", list(range(1, n + 1))).agg(F.max(visit))
    return wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in range(1, n + 1)})


def number_visits(df: DataFrame, id: str, order: Sequence[str], out: str = "n", chunk: Column | None = None) -> DataFrame:
    """Each subject's visits numbered from 1 in ``order``, as rows: any number of visits.

    With ``chunk`` (an ordered piece of the order, see :mod:`.scan`) subjects with
    very many rows are numbered piece by piece.
    """
    chunked = None if chunk is None else chunk_hot_keys(df, id, chunk)
    if chunked is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(id).orderBy(*order)))
    local = chunked.withColumn("_k", F.row_number().over(Window.partitionBy(id, "_chunk").orderBy(*order)))
    earlier = Window.partitionBy(id).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.where(F.col("_chunk").isNotNull()).groupBy(id, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(id, "_chunk", F.sum("_n").over(earlier).alias("_before"))
    return (local.join(sizes, [id, "_chunk"], "left")
            .withColumn(out, (F.col("_k") + F.coalesce("_before", F.lit(0))).cast("int")).select(*df.columns, out))
