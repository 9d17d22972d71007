"""Column helpers: selection by name pattern, recoding, labels and null rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- selection -------------------------------------------------------------


def select_prefix(df: DataFrame, keys: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """Keep ``keys`` and every column whose name starts with one of ``prefixes``."""
    picked = [c for c in df.columns if c not in keys and c.startswith(tuple(prefixes))]
    return df.select(*keys, *picked)


def select_numbered(df: DataFrame, keys: Sequence[str], stem: str, n: int) -> DataFrame:
    """Keep ``keys`` and ``stem1 … stemN``; all N columns must exist."""
    return df.select(*keys, *[f"{stem}{i}" for i in range(1, n + 1)])


def rename_all(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Bulk rename; unlike Spark's own call, an unknown source name raises."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise ValueError(f"columns to rename are missing: {missing}")
    return df.withColumnsRenamed(dict(mapping))


# --- recoding --------------------------------------------------------------


def _lookup(col: Column, mapping: Mapping) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def recode(df: DataFrame, col: str, mapping: Mapping, default: str = "keep",
           out: str | None = None) -> DataFrame:
    """Replace codes through ``mapping``.

    Codes that are not mapped stay as they are (``default='keep'``) or become
    null (``default='null'``, needed when code and label differ in type).
    """
    if default not in ("keep", "null"):
        raise ValueError("default must be 'keep' or 'null'")
    found = _lookup(F.col(col), mapping)
    value = F.coalesce(found, F.col(col)) if default == "keep" else found
    return df.withColumn(out or col, value)


def apply_labels(df: DataFrame, col: str, mapping: Mapping[str, str], out: str = "label") -> DataFrame:
    """Add the display label of a code; unlabelled codes give null."""
    return df.withColumn(out, _lookup(F.col(col), mapping))


def override(df: DataFrame, overrides: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Overwrite ``cols`` on the rows whose key occurs in ``overrides``.

    An override value of null also overwrites. ``overrides`` needs one row per key.
    """
    side = overrides.select(
        *key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = df.join(side, list(key), "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in cols}
    return joined.withColumns(new).select(*df.columns)


# --- nulls -----------------------------------------------------------------


def nullify(df: DataFrame, cols: Sequence[str], sentinels: Iterable) -> DataFrame:
    """Turn sentinel values (``-99``, ``'.'``, ``''``) into null."""
    marks = list(sentinels)
    return df.withColumns(
        {c: F.when(~F.coalesce(F.col(c).isin(marks), F.lit(False)), F.col(c)) for c in cols})


def try_number(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; text that holds no number becomes null."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in cols})


def lt_missing_low(a: str | Column, b: str | Column) -> Column:
    """``a < b`` where missing sorts below every number; never null."""
    a, b = _col(a), _col(b)
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


def le_missing_low(a: str | Column, b: str | Column) -> Column:
    """``a <= b`` where missing sorts below every number; never null."""
    a, b = _col(a), _col(b)
    return a.isNull() | F.coalesce(a <= b, F.lit(False))


def gt_missing_low(a: str | Column, b: str | Column) -> Column:
    return lt_missing_low(b, a)


# --- flags -----------------------------------------------------------------


def any_flag(*cols: str | Column) -> Column:
    """1 when any column equals 1, else 0; nulls count as "no"."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(_col(c) == 1, F.lit(False))
    return hit.cast("int")


def flag_when(condition: Column) -> Column:
    """Condition as 0/1 that stays null when the condition is null."""
    return condition.cast("int")


def first_set(choices: Mapping[str, Column]) -> Column:
    """Name of the first condition (in mapping order) that holds, else null."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in choices.items()])


def round_even(col: str | Column, digits: int) -> Column:
    """Round with ties to even."""
    return F.bround(_col(col), digits)


def wall_micros(col: str | Column) -> Column:
    """Microseconds since 1970 of the clock reading; no time zone is involved."""
    c = _col(col)
    seconds = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
